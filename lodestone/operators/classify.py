"""Classes of vertices and edges, pattern rules over edges, roles of signals by structure, and handshakes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..graph import PropertyGraph


def node_class(control: tuple[str, ...] = S.CONTROL_NAMES, data: tuple[str, ...] = S.DATA_NAMES) -> tuple[Column, Column]:
    """Class and confidence (hundredths) of a vertex row."""
    name, kind = F.lower("name"), F.col("kind")
    is_control, is_data = S.contains_any(name, control), S.contains_any(name, data)
    width = F.when(F.col("width_msb") >= F.col("width_lsb"), F.col("width_msb") - F.col("width_lsb") + 1).otherwise(1)
    rules = [
        (F.col("is_clock"), "CLOCK", 100), (F.col("is_reset"), "RESET", 100), (kind == "PARAM", "DATA", 80), (kind == "CONST", "DATA", 90), (kind == "INSTANTIATED_MODULE", "UNKNOWN", 0), (F.col("is_enable"), "CONTROL", 80),
        (is_control & is_data, "DATA", 60), (is_control, "CONTROL", 70), (is_data, "DATA", 70), ((width == 1) & (kind == "REG"), "CONTROL", 50), (width == 1, "CONTROL", 40), (width > 1, "DATA", 60),
    ]
    cls, conf = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2])
    for when, c, k in rules[1:]:
        cls, conf = cls.when(when, c), conf.when(when, k)
    return cls.otherwise("UNKNOWN"), conf.otherwise(0)


def nodes(g: PropertyGraph, control: tuple[str, ...] = S.CONTROL_NAMES, data: tuple[str, ...] = S.DATA_NAMES) -> DataFrame:
    """(id, class, confidence in hundredths); control and data: what names of each class contain (sources.config.patterns)."""
    cls, conf = node_class(control, data)
    return g.vertices.select("id", cls.alias("class"), conf.cast("bigint").alias("confidence"))


def edges(g: PropertyGraph, control: tuple[str, ...] = S.CONTROL_NAMES, data: tuple[str, ...] = S.DATA_NAMES) -> DataFrame:
    """(src, dst, kind, condition, class, key_control, confidence in hundredths) of every edge."""
    n = nodes(g, control, data)
    e = g.edges.join(n.select(F.col("id").alias("src"), F.col("class").alias("s")), "src", "left").join(n.select(F.col("id").alias("dst"), F.col("class").alias("d")), "dst", "left").na.fill("UNKNOWN", ["s", "d"])
    s, d, kind = F.col("s"), F.col("d"), F.col("kind")
    rules = [
        (kind == "CLOCK", "CLOCK", True, 100), (kind == "RESET", "RESET", True, 100), ((s == "CLOCK") | (d == "CLOCK"), "CLOCK", True, 90), ((s == "RESET") | (d == "RESET"), "RESET", True, 90), (kind == "CONNECTION", "DATA", False, 0),
        ((kind == "DRIVER") & (s == "CONTROL") & (d == "DATA"), "CONTROL", True, 80), ((kind == "DRIVER") & ((s == "DATA") | (d == "DATA")), "DATA", False, 70), ((kind == "DRIVER") & (F.col("condition") != ""), "DATA", True, 50), (kind == "BIT_SELECT", "DATA", False, 50),
    ]
    cols = [F.when(rules[0][0], F.lit(rules[0][i])) for i in (1, 2, 3)]
    for r in rules[1:]:
        cols = [c.when(r[0], F.lit(v)) for c, v in zip(cols, r[1:], strict=True)]
    return e.select("src", "dst", "kind", "condition", cols[0].otherwise("UNKNOWN").alias("class"), cols[1].otherwise(False).alias("key_control"), cols[2].otherwise(0).cast("bigint").alias("confidence"))


@dataclass(frozen=True)
class Rule:
    """A pattern over edges: the transform returns the edges (src, dst) that match. The lowest priority number wins."""

    name: str
    priority: int
    match: Callable[[PropertyGraph], DataFrame]


def convergence(least: int = 2) -> Rule:
    """Vertices that at least `least` conditional and one unconditional DRIVER edge enter, as a clamp or a saturation does."""

    def match(g: PropertyGraph) -> DataFrame:
        e = g.edges.where(F.col("kind") == "DRIVER")
        n = e.groupBy("dst").agg(F.count_if(F.col("condition") != "").alias("c"), F.count_if(F.col("condition") == "").alias("p")).where((F.col("c") >= least) & (F.col("p") >= 1))
        return e.join(n, "dst", "left_semi").select("src", "dst").distinct()

    return Rule("CONVERGENCE", 10, match)


def clamp(compare: tuple[str, ...] = ("GreaterThan", "GreaterThanEqual", "LessThan", "LessThanEqual"), distinct: int = 2) -> Rule:
    """Convergence whose conditional sources are fed by `distinct` different comparisons or more (1: a saturation). Edges have the
    operator that they come out of as assign_type."""

    def match(g: PropertyGraph) -> DataFrame:
        e = g.edges.where(F.col("kind") == "DRIVER")
        into = convergence().match(g)
        ops = e.where(F.col("assign_type").isin(*compare)).select(F.col("dst").alias("src"), F.col("assign_type").alias("op"))
        seen = e.where(F.col("condition") != "").select("src", "dst").join(ops, "src").groupBy("dst").agg(F.count_distinct("op").alias("n")).where(F.col("n") >= distinct)
        cond = e.where(F.col("condition") != "").select("src", "dst").distinct()
        return into.join(cond, ["src", "dst"], "left_semi").join(seen, "dst", "left_semi").select("src", "dst")

    return Rule("CLAMP" if distinct > 1 else "SATURATION", 30 if distinct > 1 else 10, match)


def rounding() -> Rule:
    """An arithmetic shift right of what an addition feeds (half up), or an addition of parts of at most two vectors (to even)."""

    def match(g: PropertyGraph) -> DataFrame:
        e = g.edges.select("src", "dst", F.col("assign_type").alias("op"))
        added = e.where("op = 'Add'").select(F.col("dst").alias("src")).distinct()
        half = e.where("op = 'ArithmeticShiftRight'").join(added, "src", "left_semi").select("src", "dst")
        parts = e.select(F.col("dst").alias("src"), F.col("src").alias("part")).where(F.col("part").contains("["))
        bases = e.where("op = 'Add'").select("src", "dst").join(parts, "src").groupBy("dst").agg(F.count_distinct(F.regexp_replace("part", r"\[.*$", "")).alias("n")).where("n <= 2")
        return half.union(e.where("op = 'Add'").join(bases, "dst", "left_semi").select("src", "dst")).distinct()

    return Rule("ROUNDING", 20, match)


def truncation() -> Rule:
    return Rule("TRUNCATION", 15, lambda g: g.edges.where(F.col("expression").rlike(r"\[\s*\d+(\s*:\s*\d+)?\s*\]")).select("src", "dst").distinct())


def widening() -> Rule:
    """A signed cast into a wider vertex."""

    def match(g: PropertyGraph) -> DataFrame:
        w = g.vertices.select("id", (F.col("width_msb") - F.col("width_lsb")).alias("w"))
        e = g.edges.where(F.col("expression").contains("$signed"))
        e = e.join(w.select(F.col("id").alias("src"), F.col("w").alias("sw")), "src").join(w.select(F.col("id").alias("dst"), F.col("w").alias("dw")), "dst")
        return e.where("dw > sw").select("src", "dst").distinct()

    return Rule("SIGN_EXTEND", 25, match)


def default_rules() -> list[Rule]:
    """The rules that are tried unless others are given, by priority: 10, 15, 20, 25, 30."""
    return [clamp(distinct=1), truncation(), rounding(), widening(), clamp()]


def annotated(g: PropertyGraph, rules: list[Rule]) -> DataFrame:
    """Top edges with the rule of their pair, '' where none matches."""
    return g.top_edges().join(matches(g, rules), ["src", "dst"], "left").na.fill("", ["rule"])


def matches(g: PropertyGraph, rules: list[Rule]) -> DataFrame:
    """(src, dst, rule): the rule of lowest priority number for each pair that one matches."""
    found = None
    for r in rules:
        one = r.match(g).select("src", "dst", F.struct(F.lit(r.priority).alias("p"), F.lit(r.name).alias("rule")).alias("m"))
        found = one if found is None else found.unionByName(one)
    return found.groupBy("src", "dst").agg(F.min("m").alias("m")).select("src", "dst", F.col("m.rule").alias("rule"))


# Roles in the order that decides ties, hundredths that speak for them, and the least that counts.
ROLES, LEAST_ROLE = ("valid", "ready", "data", "addr", "resp", "ctrl", "strb", "last"), 30


def roles(signals: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """signals (name, width, direction, driver_kind; a key of names may be `module` too) → scores of each role in hundredths, 0
    to 100, and the best one (30 at least; ties by the order of the roles).

    pairs (name, other, and module if signals have it): signals that belong together, by which each speaks for the other: one
    bit out with one bit in for valid and ready; one bit out with a wide one out, but without a one-bit input, for last; a few
    bits out with a wide one out for strb; a wide one with a narrow one of its own direction for data.
    """
    key = [c for c in ("module", "name") if c in signals.columns]
    w, d = S.width_class(F.col("width")), F.col("direction")
    one, small, wide, out, inp, both = w == "1bit", w == "small", w == "wide", d == "output", d == "input", d == "inout"
    base = signals.select(*key, w.alias("w"), d.alias("d"), "driver_kind")
    n = {x: F.lit(0) for x in ("input", "flip", "wide_out", "narrow")}
    if pairs is not None:
        other = signals.select(*[c for c in key if c != "name"], F.col("name").alias("other"), S.width_class(F.col("width")).alias("ow"), F.col("direction").alias("od"))
        met = pairs.select(*key, "other").distinct().join(other, [*[c for c in key if c != "name"], "other"]).join(signals.select(*key, w.alias("w"), d.alias("d")), key)
        count = lambda x, name: F.count_if(x).alias(name)
        met = met.groupBy(*key).agg(
            count((F.col("ow") == "1bit") & (F.col("od") == "input"), "input"), count((F.col("w") == "1bit") & (F.col("ow") == "1bit") & (F.col("d") != F.col("od")) & F.col("d").isin("output", "input") & F.col("od").isin("output", "input"), "flip"),
            count((F.col("ow") == "wide") & (F.col("d") == "output") & (F.col("od") == "output"), "wide_out"), count(F.col("ow").isin("1bit", "small") & (F.col("d") == F.col("od")) & F.col("d").isin("output", "input"), "narrow"))
        base = base.join(met, key, "left").na.fill(0, list(n))
        n = {x: F.col(x) for x in n}
    w, d = F.col("w"), F.col("d")
    one, small, wide, out, inp, both = w == "1bit", w == "small", w == "wide", d == "output", d == "input", d == "inout"
    alone = F.when(n["input"] == 0, n["wide_out"]).otherwise(0)
    score = {
        "valid": F.when(one & out, F.when(F.col("driver_kind") == "register", 50).otherwise(30) + 20 * n["flip"] - 25 * alone).when(one & both, 5).otherwise(0),
        "ready": F.when(one & inp, F.when(F.col("driver_kind") == "wire", 40).otherwise(30) + 20 * n["flip"]).when(one & both, 5).otherwise(0),
        "data": F.when(wide, 30 + 10 * n["narrow"]).otherwise(0),
        "addr": F.when(wide & (out | both), 30).otherwise(0),
        "resp": F.when(small & inp, 40).otherwise(0),
        "ctrl": F.when(small & ~inp, 30 - 10 * alone).otherwise(0),
        "strb": F.when(one & out, 10).when(small & out, 30 * alone).otherwise(0),
        "last": F.when(one & out, 10 + 35 * alone).otherwise(0),
    }
    score = {k: F.greatest(F.lit(0), F.least(F.lit(100), score[k])) for k in ROLES}
    best = F.greatest(*score.values())
    role = F.when(best < LEAST_ROLE, "")
    for k, v in score.items():
        role = role.when(v == best, k)
    return base.select(*key, *[v.cast("bigint").alias(k) for k, v in score.items()], role.alias("role"))


def valid_ready_pairs(ports: DataFrame) -> DataFrame:
    """ports (module, name, width; direction if they have it) → (module, base, valid, ready): one-bit valid and ready of equal base
    in one module, of opposite directions."""
    if "direction" in ports.columns:
        found = valid_ready_pairs(ports.drop("direction"))
        of = lambda x: ports.select("module", F.col("name").alias(x), F.col("direction").alias(x[0])).distinct()
        return found.join(of("valid"), ["module", "valid"]).join(of("ready"), ["module", "ready"]).where("v != r").select("module", "base", "valid", "ready")
    x = ports.where("width = 1").select("module", "name", F.lower("name").alias("n"))
    v = x.where(F.col("n").endswith("valid")).select("module", F.regexp_replace("n", "_?valid$", "").alias("base"), F.col("name").alias("valid"))
    r = x.where(F.col("n").endswith("ready")).select("module", F.regexp_replace("n", "_?ready$", "").alias("base"), F.col("name").alias("ready"))
    return v.join(r, ["module", "base"])
