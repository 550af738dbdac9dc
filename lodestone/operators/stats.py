"""Counts, rankings and risk scores of vertices. Scores are integers of tenths, so that no sum depends on its order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..functions.scalars import contains_any


def totals(g: PropertyGraph) -> DataFrame:
    return g.vertices.agg(F.count("*").alias("nodes")).join(g.pairs().agg(F.count("*").alias("pairs"))).join(g.edges.agg(F.count("*").alias("edges")))


def kind_histogram(g: PropertyGraph) -> DataFrame:
    return g.vertices.groupBy("kind").agg(F.count("*").alias("n"))


def edge_histogram(g: PropertyGraph) -> DataFrame:
    """(kind, n_pairs: pairs whose top edge is of the kind, n_edges)."""
    top = g.top_edges().groupBy("kind").agg(F.count("*").alias("n_pairs"))
    return g.edges.groupBy("kind").agg(F.count("*").alias("n_edges")).join(top, "kind", "left").select("kind", F.coalesce("n_pairs", F.lit(0)).cast("bigint").alias("n_pairs"), "n_edges")


def suggestion(name: Column, fanout: Column, is_clock: Column, is_reset: Column) -> Column:
    """What a high fan-out asks for; '' if nothing."""
    n = F.lower(name)
    clock, reset = is_clock | n.contains("clk"), is_reset | contains_any(n, ("rst", "reset"))
    enable = contains_any(n, ("en", "valid", "ready"))
    return (
        F.when(clock & (fanout > 100), "gate the clock").when(clock & (fanout > 50), "optimise the clock's fan-out")
        .when(reset & (fanout > 100), "reset by module").when(reset & (fanout > 50), "reset in steps")
        .when(fanout > 50, "split the signal").when(enable & (fanout > 20), "enable with a high fan-out").otherwise("")
    )


def fanout_rank(g: PropertyGraph, kind: str = "DRIVER") -> DataFrame:
    """(id, kind, fanout, suggestion) of every source of edges of the kind."""
    n = g.edges.where(F.col("kind") == kind).select("src", "dst").distinct().groupBy("src").agg(F.count("*").alias("fanout"))
    v = g.vertices
    return n.join(v, n["src"] == v["id"]).select("id", "kind", "fanout", suggestion(F.substring_index("id", ".", -1), F.col("fanout"), F.col("is_clock"), F.col("is_reset")).alias("suggestion"))


def fanout_loads(g: PropertyGraph) -> DataFrame:
    """(id, rank, load): the loads that fanout_rank() counts, for each source in order."""
    e = g.edges.where("kind = 'DRIVER'").select(F.col("src").alias("id"), F.col("dst").alias("load")).distinct()
    return e.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("load")).cast("bigint")).select("id", "rank", "load")


def net_fanouts(g: PropertyGraph, kind: str = "DRIVER") -> DataFrame:
    """(clock_fanout, reset_fanout): the largest fan-outs of a clock and of a reset over edges of the kind, 0 if there is none."""
    n = g.edges.where(F.col("kind") == kind).select("src", "dst").distinct().groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    of = lambda c: F.coalesce(F.max(F.when(F.col(f"is_{c}"), F.col("n"))), F.lit(0)).cast("bigint").alias(f"{c}_fanout")
    return n.join(g.vertices.select("id", "is_clock", "is_reset"), "id").agg(of("clock"), of("reset"))


def level(score: Column) -> Column:
    """Level of a score in tenths."""
    return F.when(score >= 400, "CRITICAL").when(score >= 250, "HIGH").when(score >= 150, "MEDIUM").otherwise("LOW")


def risk(g: PropertyGraph, covered: DataFrame, comb_depth: int = 0, parity_width: bool = True) -> DataFrame:
    """Functional and timing scores (tenths) of all vertices but clocks and resets. covered (name, has_sva, has_cov): one row
    for a name. parity_width: a descending range counts as one bit, as lsb - msb + 1 does."""
    v = g.vertices.where(~F.col("is_clock") & ~F.col("is_reset")).withColumn("bare", F.substring_index("id", ".", -1))
    width = F.greatest(F.lit(1), (F.col("width_lsb") - F.col("width_msb") if parity_width else F.col("width_msb") - F.col("width_lsb")) + 1)
    out = v.join(g.degrees(), "id").join(covered.withColumnRenamed("name", "bare"), "bare", "left").na.fill(False, ["has_sva", "has_cov"])
    fan_in, fan_out = F.col("fan_in"), F.col("fan_out")
    func = fan_in * 30 + fan_out * 20 + width * 3 + F.when(fan_in >= 3, 150).otherwise(0) + F.when(fan_out >= 3, 100).otherwise(0) + F.when(F.col("has_sva"), 0).otherwise(120) + F.when(F.col("has_cov"), 0).otherwise(80)
    timing = F.when(F.col("kind") == "REG", 150).otherwise(0) + fan_in * 20 + comb_depth * 50
    return out.select("id", "kind", "fan_in", "fan_out", "has_sva", "has_cov", func.cast("bigint").alias("func_tenths"), level(func).alias("func_level"), timing.cast("bigint").alias("timing_tenths"), level(timing).alias("timing_level"))


def gaps(scored: DataFrame, min_tenths: int, top: int | None = None) -> DataFrame:
    """Rows of risk() that no coverage has and whose total is min_tenths at least, the highest first."""
    out = scored.withColumn("total_tenths", F.col("func_tenths") + F.col("timing_tenths")).where(~F.col("has_sva") & ~F.col("has_cov") & (F.col("total_tenths") >= min_tenths))
    return out if top is None else out.orderBy(F.desc("total_tenths"), "id").limit(top)


def path_risk(length: Column, fanout: Column, covered: Column, name: Column, condition: Column) -> Column:
    n = F.lower(name)
    return (
        length * 5 + fanout * 2 + F.when(covered, 0).otherwise(20) + F.when(fanout > 10, 15).when(fanout > 5, 10).otherwise(0)
        + F.when(contains_any(n, ("clk", "clock")), 20).otherwise(0) + F.when(contains_any(n, ("rst", "reset")), 20).otherwise(0) + F.when(condition != "", 10).otherwise(0)
    ).cast("bigint")


def risk_level(score: Column, least: int) -> Column:
    return F.when(score >= least, "HIGH").when(score * 10 >= least * 6, "MEDIUM").otherwise("LOW")


def capped(df: DataFrame, group: str, order: list, cap: int) -> DataFrame:
    """At most `cap` rows of each group in order, with the group's whole count and whether it was cut."""
    n = F.count("*").over(Window.partitionBy(group))
    r = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("pre_cap", n).withColumn("rank", r.cast("bigint")).where(F.col("rank") <= cap).withColumn("truncated", F.col("pre_cap") > cap)


def anomalies(g: PropertyGraph) -> DataFrame:
    """(id, anomaly): no driver but loads, drivers but no load, or neither; ports are left out."""
    d = g.degrees().join(g.vertices.where(~F.col("is_port")).select("id"), "id", "left_semi")
    a = F.when((F.col("fan_in") == 0) & (F.col("fan_out") > 0), "X_DRIVER").when((F.col("fan_in") > 0) & (F.col("fan_out") == 0), "DANGLING").when((F.col("fan_in") == 0) & (F.col("fan_out") == 0), "ORPHAN")
    return d.select("id", a.alias("anomaly")).where("anomaly is not null")
