"""What elaboration adds to a graph, over tables: edges of concatenations by bits, constraints that classes inherit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .traverse import ancestors, reach


def concatenations(parts: DataFrame) -> DataFrame:
    """parts (assign, side: 'lhs' or 'rhs', position from the left, name, width) → (assign, src, dst, src_msb, src_lsb, dst_msb,
    dst_lsb): which bits of which operand on the right drive which bits on the left, both sides being laid out from their least
    significant bit, the last operand (of equal positions by name, then width). Bits that only one side has drive and are driven by nothing; operands of no width go.

    Ends of operands cut both sides into stretches; a stretch has one operand of each side, the last that began, so there is a
    window over the operands of an assignment, not a comparison of each with each."""
    right = Window.partitionBy("assign", "side").orderBy(F.desc("position"), F.desc("name"), F.desc("width")).rowsBetween(Window.unboundedPreceding, 0)
    p = parts.where("width > 0").select("assign", "side", "position", "name", F.col("width").cast("bigint").alias("width"))
    p = p.withColumn("hi", F.sum("width").over(right)).withColumn("lo", F.col("hi") - F.col("width"))
    begins = F.struct("lo", "hi", "name")
    one = lambda side: F.max(F.when(F.col("side") == side, begins)).alias(side)  # noqa: E731  one operand of a side begins at a bit
    at = p.groupBy("assign", F.col("lo").alias("at")).agg(one("lhs"), one("rhs"))
    order = Window.partitionBy("assign").orderBy("at")
    at = at.select("assign", "at", F.last("lhs", True).over(order).alias("l"), F.last("rhs", True).over(order).alias("r"), F.lead("at").over(order).alias("next"))
    to = F.least("next", "l.hi", "r.hi")
    cut = at.where(F.col("l").isNotNull() & F.col("r").isNotNull() & (F.col("at") < F.least("l.hi", "r.hi")))
    bits = lambda x: [(to - 1 - F.col(f"{x}.lo")).alias("m"), (F.col("at") - F.col(f"{x}.lo")).alias("n")]
    return cut.select("assign", F.col("r.name").alias("src"), F.col("l.name").alias("dst"), bits("r")[0].alias("src_msb"), bits("r")[1].alias("src_lsb"), bits("l")[0].alias("dst_msb"), bits("l")[1].alias("dst_lsb"))


def inherited(classes: DataFrame, constraints: DataFrame) -> DataFrame:
    """classes (id, parent), constraints (class, name, id) → (class, name, id, origin, level): the constraints that hold in each
    class: of a name the definition of the nearest class, itself first (level 0), then up the hierarchy; of several of a name in
    one class the least id. Classes that only stand as parents count too."""
    own = classes.select("id").union(classes.select("parent")).where("id is not null").distinct()
    up = ancestors(classes.select("id", "parent")).unionByName(own.select("id", F.col("id").alias("ancestor"), F.lit(0).cast("bigint").alias("level")))
    # A class on a cycle is its own ancestor, further away than itself.
    up = up.groupBy("id", "ancestor").agg(F.min("level").alias("level"))
    found = up.join(constraints.select(F.col("class").alias("ancestor"), "name", F.col("id").alias("constraint")), "ancestor")
    best = found.groupBy(F.col("id").alias("class"), "name").agg(F.min(F.struct("level", F.col("ancestor").alias("origin"), F.col("constraint").alias("id"))).alias("b"))
    return best.select("class", "name", "b.id", "b.origin", "b.level")


def copied(held: DataFrame, nodes: DataFrame) -> DataFrame:
    """inherited(), nodes (id, parent, ...: trees whose tops are constraints) → (class, id, parent, of, ...): the whole tree of every
    constraint that a class has from another one, copied under new ids, class::id; `of` is the node that was copied. Other
    columns of the nodes are copied as they are."""
    tree = nodes.where("parent is not null").select(F.col("parent").alias("src"), F.col("id").alias("dst"))
    tops = held.where("level > 0").select(F.col("id").alias("root"), "id").distinct()
    inside = stored(reach(tree, tops).select("root", "id").union(tops))
    heirs = held.where("level > 0").select("class", F.col("id").alias("root"))
    new = lambda c: F.concat_ws("::", "class", c)
    rest = [c for c in nodes.columns if c not in ("id", "parent")]
    out = heirs.join(inside, "root").join(nodes, "id")
    parent = F.when(F.col("id") == F.col("root"), F.lit(None)).otherwise(new("parent"))
    return out.select("class", new("id").alias("new"), parent.alias("parent"), F.col("id").alias("of"), *rest).withColumnRenamed("new", "id")
