"""The recursive join: reach, fan-in and fan-out are policies over one frontier loop."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..graph import PropertyGraph
from ..storage import Segments, apart, counted, parts, placed

DATA_KINDS = ("DRIVER", "CONNECTION")
#: Rows of a level from which on the steps, and what was reached, lie in buckets; rows of a bucket that are hashed in memory at most.
WIDE, HASHED = 100_000, 500_000
#: How many times the pairs that are known a round of from_all() may make; beyond it goes level by level.
FACTOR = 8


def waves(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, reverse: bool = False, descend: Column | None = None) -> Iterator[tuple[Segments, int]]:
    """reach(), level by level: all that was reached so far (root, id, level) and how many rows the level added, at first none and
    the number of starts."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    steps = edges.select(F.col(a).alias("id"), F.col(b).alias("next"))
    frontier, n = counted(starts.select("root", "id").distinct())
    seen, level = Segments(frontier.select("root", "id", F.lit(0).cast("bigint").alias("level")).limit(0), 0), 0
    yield seen, n
    while n and (max_depth is None or level < max_depth):
        level += 1
        if not seen.by and n > WIDE and (max_depth is None or max_depth - level > 2):
            buckets, key = parts(steps.sparkSession, max(n, steps.count())), ("root", "id")
            steps, _ = placed(steps.repartition(buckets, "id"), "id", buckets)
            so_far, k = placed(seen.table().repartition(buckets, *key), key, buckets)
            seen = Segments(so_far, k, key, buckets)
        found = frontier.join(steps, "id").select("root", F.col("next").alias("id"))
        if seen.by:
            found = found.repartition(seen.buckets, "root", "id").distinct()
            if seen.parts:
                found, n = placed(found, seen.by, seen.buckets)  # each part of what was reached reads it
                found = found.join(seen.met(found), ["root", "id"], "left_anti") if n <= seen.buckets * HASHED else seen.without(found)
            found, n = placed(found.withColumn("level", F.lit(level).cast("bigint")), seen.by, seen.buckets)
            seen.add(found, n)
            frontier = found.select("root", "id") if descend is None else found.select("root", "id").where(descend)
            yield seen, n
            continue
        found = found.distinct()
        if level > 1:
            found = found.join(seen.table().select("root", "id"), ["root", "id"], "left_anti")
        found, n = counted(found)
        seen.add(found.withColumn("level", F.lit(level).cast("bigint")), n)
        frontier = found if descend is None else found.where(descend)
        yield seen, n


def reach(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, reverse: bool = False, descend: Column | None = None, most: bool = False) -> DataFrame:
    """starts (root, id) → (root, id, level): every vertex that a root reaches over edges (src, dst), at its least level,
    1 or more; a start is in the result only if it is reached again. Every root is followed in one loop.

    descend: a condition on the column id; vertices that fail it are reached but not left. Each level is written, so no
    level's plan holds another's, and is joined with the edges: a small frontier is broadcast by its known size and
    nothing else is shuffled; visited vertices leave by an anti join. Once a level has over WIDE rows the edges are put into buckets
    of their sources and what was reached into buckets of (root, id): from then on a level shuffles its own rows only. Levels are
    merged as they grow many. The edges are read at each level: what is costly to make is to be stored before.
    most: each start is its own root, and they are most of the sources of edges; without bounds from_all() then takes fewer rounds.
    """
    if most and max_depth is None and not reverse and descend is None:
        return from_all(edges).join(starts.select("root").distinct(), "root", "left_semi")
    for seen, _ in waves(edges, starts, max_depth, reverse, descend):
        pass
    return seen.table()


def from_all(edges: DataFrame) -> DataFrame:
    """edges (src, dst) → (root, id, level): reach() from every source, in as many rounds as the longest way has binary digits.

    A round joins the pairs at the greatest distance so far, k, with all that were found: what is up to 2 * k away is k away from
    the root and up to k from there. Where that would make many rows for a pair, as a grid does, each level is one round instead."""
    steps, n = counted(edges.select(F.col("src").alias("root"), F.col("dst").alias("id")).distinct())
    buckets = parts(steps.sparkSession, n)
    known, k = steps.withColumn("level", F.lit(1).cast("bigint")), 1
    known, n = placed(known.repartition(buckets, "root"), "root", buckets)
    while n:
        last = known.where(F.col("level") == k)
        fan = known.groupBy("root").agg(F.count("*").alias("fan"))
        made = last.groupBy(F.col("id").alias("root")).agg(F.count("*").alias("n")).join(fan, "root").agg(F.sum(F.col("n") * F.col("fan"))).first()[0]
        if not made:
            break
        if made > FACTOR * n:
            ids = steps.select("root", F.col("root").alias("id")).distinct()
            return reach(edges, ids)
        far = last.select(F.col("root").alias("from"), F.col("id").alias("root")).join(known, "root").select(F.col("from").alias("root"), "id", (F.col("level") + k).alias("level"))
        both = apart(known, ["root", "id"]).unionByName(apart(far, ["root", "id"]))
        buckets = parts(steps.sparkSession, n + made)
        known, n = placed(both.repartition(buckets, "root").groupBy("root", "id").agg(F.min("level").alias("level")), "root", buckets)
        k *= 2
    return known


def roots(spark, ids: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, i) for i in ids], "root string, id string")


def fan_out(g: PropertyGraph, starts: DataFrame, depth: int | None = None, kinds: tuple[str, ...] = DATA_KINDS, include_clock: bool = False, include_reset: bool = False, include_control: bool = False) -> DataFrame:
    """Loads of each start over edges of the kinds; control: over any edge with a condition too."""
    wanted = (*kinds, *(("CLOCK",) if include_clock else ()), *(("RESET",) if include_reset else ()))
    keep = F.col("kind").isin(*wanted)
    return reach(g.edges.where(keep | (F.col("condition") != "") if include_control else keep), starts, depth)


def fan_in(g: PropertyGraph, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """Drivers of each start: direct predecessors over any kind at depth 1, else over data edges; constants are leaves."""
    if depth == 1:
        return reach(g.edges, starts, 1, reverse=True)
    return reach(g.edges.where(F.col("kind").isin(*DATA_KINDS)), starts, depth, reverse=True, descend=~S.is_literal(F.col("id")))


def closure(g: PropertyGraph, starts: DataFrame, kind: str, reverse: bool = False) -> DataFrame:
    """Reach over a single kind of edge, to the end."""
    return reach(g.edges.where(F.col("kind") == kind), starts, None, reverse)


def confidence(n: str = "n") -> Column:
    """How sure a number of loads makes a trace."""
    return F.when(F.col(n) == 0, "no_load").when(F.col(n) == 1, "high").otherwise("medium")


def neighbourhood(g: PropertyGraph, starts: DataFrame, depth: int) -> PropertyGraph:
    """The subgraph within `depth` hops of the starts, either way."""
    both = g.edges.select("src", "dst").union(g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    near = reach(both, starts, depth).select("id").union(starts.select("id")).distinct()
    inside = g.edges.join(near.withColumnRenamed("id", "src"), "src", "left_semi").join(near.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return PropertyGraph(g.vertices.join(near, "id", "left_semi"), inside.select(*g.edges.columns))


def nearest(edges: DataFrame, targets: DataFrame, max_depth: int, reverse: bool = False) -> DataFrame:
    """(id, root, level): for each vertex the nearest of the targets (id) that it reaches, ties by the smallest id."""
    found = reach(edges, targets.select(F.col("id").alias("root"), "id"), max_depth, reverse=not reverse)
    return found.groupBy("id").agg(F.min(F.struct("level", "root")).alias("m")).select("id", F.col("m.root").alias("root"), F.col("m.level").alias("level"))


def ancestors(parents: DataFrame, max_depth: int | None = None) -> DataFrame:
    """parents (id, parent) → (id, ancestor, level) for every ancestor."""
    steps = parents.select(F.col("id").alias("src"), F.col("parent").alias("dst")).where("dst is not null")
    starts = steps.select(F.col("src").alias("root"), F.col("src").alias("id"))
    return reach(steps, starts, max_depth).select(F.col("root").alias("id"), F.col("id").alias("ancestor"), "level")


def subclasses(parents: DataFrame, of: str) -> DataFrame:
    return parents.where(F.col("parent") == of).select("id")


def descendants(parents: DataFrame, of: str, max_depth: int | None = None) -> DataFrame:
    """(id, level): all that lie below."""
    steps = parents.select(F.col("parent").alias("src"), F.col("id").alias("dst")).where("src is not null")
    return reach(steps, roots(parents.sparkSession, [of]), max_depth).select("id", "level")


def depths(parents: DataFrame) -> DataFrame:
    """(id, depth, top): how far each lies below its topmost ancestor, and that; a root is its own, at depth 0."""
    up = ancestors(parents).groupBy("id").agg(F.max("level").alias("depth"), F.max_by("ancestor", "level").alias("top"))
    every = parents.select("id").union(parents.select("parent")).where("id is not null").distinct()
    return every.join(up, "id", "left").select("id", F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"), F.coalesce("top", "id").alias("top"))


def is_ancestor(parents: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (ancestor, descendant) → those that are."""
    a = ancestors(parents).select(F.col("id").alias("descendant"), "ancestor")
    return pairs.join(a, ["ancestor", "descendant"], "left_semi")
