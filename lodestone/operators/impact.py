"""What a change of a signal comes to: each of its loads with its risk, kind and coverage, and what to do about it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import contains_any
from ..graph import PropertyGraph
from .stats import path_risk, risk_level

# Fan-outs over which a load, and a net of clock or reset, is called large.
LARGE, VERY_LARGE = 10, 50


def paths(g: PropertyGraph, loads: DataFrame, covered: DataFrame, least: int = 30, by_level: bool = False) -> DataFrame:
    """loads (root, id, level; as fan_out() gives them), covered (id, has_sva, has_cov) → (root, id, level, path_type, fanout, condition,
    clock_domain, has_sva, has_cov, score, risk, advice).

    A path counts as its two ends, or with by_level as all the vertices of a shortest one. fanout: the vertices that the load drives;
    condition, clock and assignment are those of the top edge from root to load, if there is one: its path is clocked if the
    assignment is nonblocking, else conditional if there is a condition, else combinational. Rows of covered that repeat an id add up."""
    top = g.top_edges()
    drives = top.where("kind = 'DRIVER'").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("fanout"))
    marks = covered.groupBy("id").agg(F.bool_or("has_sva").alias("has_sva"), F.bool_or("has_cov").alias("has_cov"))
    edge = top.select(F.col("src").alias("root"), F.col("dst").alias("id"), "condition", "clock_domain", "assign_type")
    x = loads.select("root", "id", "level").join(drives, "id", "left").join(marks, "id", "left").join(edge, ["root", "id"], "left")
    x = x.na.fill(0, ["fanout"]).na.fill(False, ["has_sva", "has_cov"]).na.fill("", ["condition", "clock_domain", "assign_type"])
    seen, n = F.col("has_sva") | F.col("has_cov"), F.col("fanout")
    length = F.col("level") + 1 if by_level else F.lit(2)
    last = lambda c: F.element_at(F.split(c, r"\."), -1)
    x = x.withColumn("score", path_risk(length, n, seen, last("root"), F.col("condition"))).withColumn("risk", risk_level(F.col("score"), least))
    kind = F.when(F.col("assign_type") == "nonblocking", "clocked").when(F.col("condition") != "", "conditional").otherwise("combinational")
    high = F.col("risk") == "HIGH"
    advice = F.concat_ws(
        "; ",
        F.when(high & ~seen, "cover this path"),
        F.when(high & (n > LARGE), F.format_string("buffer a fan-out of %d", n)),
        F.when(contains_any(F.lower(last("id")), ("clk", "rst")) & (n > VERY_LARGE), "divide the clock or reset"),
        F.when(~seen & (length > 2), "check between its ends"),
    )
    cols = ("has_sva", "has_cov", "score", "risk")
    return x.select("root", "id", "level", kind.alias("path_type"), n.cast("bigint").alias("fanout"), "condition", "clock_domain", *cols, advice.alias("advice"))


def summary(found: DataFrame) -> DataFrame:
    """paths() → (root, n_paths, high, medium, low, n_uncovered, max_score, n_modules: of what is before an id's first dot) for each root."""
    of = lambda x: F.count_if(F.col("risk") == x).alias(x.lower())
    module = F.when(F.col("id").contains("."), F.substring_index("id", ".", 1))
    cells = (F.count("*").alias("n_paths"), of("HIGH"), of("MEDIUM"), of("LOW"), F.count_if(~F.col("has_sva") & ~F.col("has_cov")).alias("n_uncovered"))
    return found.groupBy("root").agg(*cells, F.max("score").alias("max_score"), F.count_distinct(module).alias("n_modules"))
