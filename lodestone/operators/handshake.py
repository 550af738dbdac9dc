"""How a ready or valid signal is driven: a class for each driver, the surest one for a signal, and pairs of signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .ports import paired_by_base

# Classes of handshakes, how much they count against each other (higher is surer), and as evidence (hundredths).
PRIORITY = {"STANDARD_AXI": 10, "COMPLEX_ARB": 9, "COMBINATIONAL_BP": 8, "REGISTERED_BP": 7, "CONDITIONAL_CTRL": 6, "WIRE_PASSTHROUGH": 3, "PORT_PASSTHROUGH": 2, "UNUSED": 0, "UNKNOWN": 0}
EVIDENCE = {"STANDARD_AXI": 100, "COMBINATIONAL_BP": 80, "REGISTERED_BP": 70, "LATCHED_BP": 70, "WIRE_PASSTHROUGH": 40, "PORT_PASSTHROUGH": 40, "UNUSED": -30, "UNKNOWN": 0}
CONSTANTS = ("1'b1", "1", "'1", "1'h1", "true", "1'b0", "0", "'0", "1'h0", "false")
TOKENS = ("valid", "ready", "ack", "req", "stall", "wait", "grant")
NAMED_CHANNELS = ("AW", "W", "B", "AR", "R", "A", "D")
FIFO_EXPRESSION, FIFO_CONDITION = r"!\s*(\w+_)?(full|empty)\b", r"!\s*(\w+_)?(full|empty)"


def _lookup(key: Column, table: dict[str, int]) -> Column:
    out = F.when(F.lit(False), 0)
    for k, v in table.items():
        out = out.when(key == k, v)
    return out.otherwise(0)


def evidence(kind: Column) -> Column:
    """What a class says for a protocol, in hundredths; 0 for a class without a figure."""
    return _lookup(kind, EVIDENCE)


def driver_class(condition: Column, expression: Column, assign_type: Column) -> Column:
    """The class that one driver gives its signal, null if it gives none. The first rule that holds counts."""
    terms = S.split_condition(condition)
    low = F.transform(terms, F.lower)
    any_of = lambda names, words: F.exists(names, lambda x: S.contains_any(F.lower(x), words))
    free = condition == ""
    several = F.size(terms) >= 2
    return (
        F.when(free & (expression == "") & assign_type.isin("connection", ""), "PORT_PASSTHROUGH")
        .when((expression != "") & expression.rlike(FIFO_EXPRESSION), "COMBINATIONAL_BP")
        .when(free & (expression != "") & (assign_type == "continuous"), "WIRE_PASSTHROUGH")
        .when(free & expression.isin(*CONSTANTS) & assign_type.isin("nonblocking", "blocking", "always_comb", "always_ff"), "PORT_PASSTHROUGH")
        .when(several & condition.contains("||") & any_of(S.condition_names(condition), TOKENS), "COMPLEX_ARB")
        .when(several & condition.contains("&&") & any_of(low, ("valid",)) & any_of(low, ("ready",)), "STANDARD_AXI")
        .when(condition.rlike(FIFO_CONDITION), "COMBINATIONAL_BP")
        .when(free & (assign_type == "always_ff"), "REGISTERED_BP")
        .when(~free, "CONDITIONAL_CTRL")
    )


def classify(signals: DataFrame, drivers: DataFrame) -> DataFrame:
    """signals (id, kind), drivers (id, condition, expression, assign_type; as reports.driver_details gives them) →
    (id, handshake, channel, condition, n_drivers). The class of highest priority counts, ties by the longest condition and
    expression, then by text. Without a driver a PORT_IN is PORT_PASSTHROUGH and all else UNUSED; without a class, UNKNOWN."""
    d = drivers.select("id", F.trim(F.coalesce("condition", F.lit(""))).alias("condition"), F.trim(F.coalesce("expression", F.lit(""))).alias("expression"), F.coalesce("assign_type", F.lit("")).alias("assign_type"))
    d = d.withColumn("handshake", driver_class(F.col("condition"), F.col("expression"), F.col("assign_type")))
    # A class of a condition shows the condition twice, one of an expression the expression beside its condition.
    shown = F.when(F.col("handshake").isin("COMPLEX_ARB", "STANDARD_AXI", "CONDITIONAL_CTRL"), F.col("condition")).otherwise(F.col("expression"))
    rank = F.struct(F.col("handshake").isNotNull().alias("known"), _lookup(F.col("handshake"), PRIORITY).alias("priority"), (F.length("condition") + F.length(shown)).alias("size"), "condition", "handshake")
    best = d.groupBy("id").agg(F.max(rank).alias("b"), F.count("*").alias("n"))
    out = signals.select("id", "kind").join(best, "id", "left")
    kind = F.when(F.col("b").isNull(), F.when(F.col("kind") == "PORT_IN", "PORT_PASSTHROUGH").otherwise("UNUSED")).otherwise(F.coalesce("b.handshake", F.lit("UNKNOWN")))
    return out.select("id", kind.alias("handshake"), S.channel(F.col("id")).alias("channel"), F.coalesce("b.condition", F.lit("")).alias("condition"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_drivers"))


def by_name(valid: Column, ready: Column) -> Column:
    """Class of a pair by its names alone: struct (handshake, channel), null if neither says anything."""
    v, r = S.normalise(valid), S.normalise(ready)
    channel = F.when(F.lit(False), "")
    for c in NAMED_CHANNELS:
        channel = channel.when((v == c.lower() + "valid") & (r == c.lower() + "ready"), c)
    speaks = v.contains("valid") | r.contains("ready")
    return F.when(channel.isNotNull(), F.struct(F.lit("STANDARD_AXI").alias("handshake"), channel.alias("channel"))).when(speaks, F.struct(F.lit("WIRE_PASSTHROUGH").alias("handshake"), F.lit("UNKNOWN").alias("channel")))


def pairs(signals: DataFrame, most: int | None = None) -> DataFrame:
    """signals (id) → (valid, ready): valids and readies of one base, each used once, in order of ids."""
    n = F.lower(F.substring_index("id", ".", -1))
    role = F.when(n.contains("ready"), "ready").when(n.contains("valid"), "valid")
    named = signals.select("id", S.bare_base(F.col("id")).alias("base"), role.alias("role")).where("role is not null")
    return paired_by_base(named, most)


def scan(signals: DataFrame, drivers: DataFrame, most: int | None = None) -> DataFrame:
    """(valid, ready, handshake, channel) of every pair: the class of its ready."""
    found = classify(signals, drivers).select(F.col("id").alias("ready"), "handshake", "channel")
    return pairs(signals, most).join(found, "ready").select("valid", "ready", "handshake", "channel")


def anchors(signals: DataFrame) -> DataFrame:
    """signals (module, name, width, direction) → (module, valid, ready): for each one-bit valid the one-bit ready of the other
    direction in its module whose name has the longest common beginning, 2 characters at least; ties by name. Names meet by
    their first two characters, so a module's names are not all compared with each other."""
    one = signals.where("width = 1").select("module", "name", "direction", F.lower("name").alias("n"))
    head = F.substring("n", 1, 2)
    v = one.where(F.col("n").contains("valid")).select("module", F.col("name").alias("valid"), F.col("n").alias("vn"), F.col("direction").alias("vd"), head.alias("h"))
    r = one.where(F.col("n").contains("ready")).select("module", F.col("name").alias("ready"), F.col("n").alias("rn"), F.col("direction").alias("rd"), head.alias("h"))
    met = v.join(r, ["module", "h"]).where("vd != rd").withColumn("overlap", F.length(S.common_prefix(F.col("vn"), F.col("rn"))))
    best = met.groupBy("module", "valid").agg(F.min(F.struct((-F.col("overlap")).alias("o"), "ready")).alias("b"))
    return best.select("module", "valid", F.col("b.ready").alias("ready"))


def layers(signals: DataFrame, keywords: dict[str, tuple[str, ...]], most: int) -> DataFrame:
    """(id, layer): the layer of each signal by keywords, the first `most` of each layer by id."""
    from pyspark.sql import Window

    found = signals.select("id", S.layer(F.col("id"), keywords).alias("layer"))
    return found.withColumn("k", F.row_number().over(Window.partitionBy("layer").orderBy("id"))).where(F.col("k") <= most).select("id", "layer")
