"""Differences between two graphs: what came, went and changed, what is stable, and what a change reaches."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..storage import stored
from .traverse import DATA_KINDS, reach


def nodes(a: PropertyGraph, b: PropertyGraph) -> DataFrame:
    """(id, change): added, removed or modified (kind, width or module)."""
    cols = ("kind", "module", "width_msb", "width_lsb")
    x = a.vertices.select("id", F.struct(*cols).alias("old"))
    y = b.vertices.select("id", F.struct(*cols).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("modified")
    return x.join(y, "id", "full").where(~F.col("old").eqNullSafe(F.col("new"))).select("id", change.alias("change"))


def pairs(a: PropertyGraph, b: PropertyGraph) -> DataFrame:
    """(src, dst, change) of pairs that only one graph has: one aggregate over both, with a mark for each."""
    marked = a.edges.select("src", "dst", F.lit(1).alias("old"), F.lit(0).alias("new")).union(b.edges.select("src", "dst", F.lit(0), F.lit(1)))
    both = marked.groupBy("src", "dst").agg(F.max("old").alias("old"), F.max("new").alias("new"))
    return both.where("old != new").select("src", "dst", F.when(F.col("old") == 0, "added").otherwise("removed").alias("change"))


def stable_core(a: PropertyGraph, b: PropertyGraph, changed: DataFrame | None = None) -> DataFrame:
    """Vertices of both graphs none of whose pairs came or went: an anti join, rather than lists of neighbours. changed: pairs(a, b)
    where they have been made."""
    changed = pairs(a, b) if changed is None else changed
    ends = changed.select(F.col("src").alias("id")).union(changed.select("dst"))
    return a.vertices.select("id").join(b.vertices.select("id"), "id", "left_semi").join(ends, "id", "left_anti")


def health(a: PropertyGraph, b: PropertyGraph) -> DataFrame:
    """(nodes, stable, added, removed, changed, score in ten-thousandths, coupling warning)."""
    n = nodes(a, b).agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "removed").alias("removed"), F.count("*").alias("changed"))
    out = b.vertices.agg(F.count("*").alias("nodes")).join(stable_core(a, b).agg(F.count("*").alias("stable"))).join(n)
    share = F.col("stable") * 10000 / F.greatest(F.col("nodes"), F.lit(1))
    unstable = 1 - F.col("stable") / F.greatest(F.col("nodes"), F.lit(1))
    warn = F.when((F.col("changed") / F.greatest(F.col("nodes"), F.lit(1)) < 0.05) & (unstable > 0.3), F.when(unstable > 0.5, "critical").otherwise("warning")).otherwise("")
    return out.select("nodes", "stable", "added", "removed", "changed", F.floor(share).cast("bigint").alias("score"), warn.alias("coupling"))


def reachability(a: PropertyGraph, b: PropertyGraph, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """(root, id, change): newly, no_longer or still reachable from the starts (root, id)."""
    x, y = (reach(g.edges.where(F.col("kind").isin(*DATA_KINDS)), starts, depth).select("root", "id").withColumn(n, F.lit(True)) for g, n in ((a, "old"), (b, "new")))
    change = F.when(F.col("old").isNull(), "newly").when(F.col("new").isNull(), "no_longer").otherwise("still")
    return x.join(y, ["root", "id"], "full").select("root", "id", change.alias("change"))


def impact(a: PropertyGraph, b: PropertyGraph, changed: DataFrame) -> DataFrame:
    """changed (id) → (newly, no_longer, still, depth_old, depth_new): how many vertices all of them together reach in one graph
    or both, and in how many rounds: those of a search level by level until one finds nothing, that one counted; 0 where a graph has none of them."""
    def walk(g: PropertyGraph) -> tuple[DataFrame, DataFrame]:
        starts = stored(changed.select("id").distinct().join(g.vertices.select("id"), "id", "left_semi").select(F.lit("").alias("root"), "id"))
        return starts, reach(stored(g.edges.where(F.col("kind").isin(*DATA_KINDS)).select("src", "dst").distinct()), starts)

    # Most of a level's time is waiting for its few tasks, so both graphs are walked at the same time.
    with ThreadPoolExecutor(2) as both_at_once:
        sides = list(both_at_once.map(walk, (a, b)))
    rounds = []
    for name, (starts, far) in zip(("depth_old", "depth_new"), sides):
        n = far.agg(F.coalesce(F.max("level"), F.lit(0)).alias("l")).join(starts.agg(F.count("*").alias("s")))
        rounds.append(n.select(F.when(F.col("s") > 0, F.col("l") + 1).otherwise(0).cast("bigint").alias(name)))
    marked = sides[0][1].select("id", F.lit(1).alias("old"), F.lit(0).alias("new")).union(sides[1][1].select("id", F.lit(0), F.lit(1)))
    both = marked.groupBy("id").agg(F.max("old").alias("old"), F.max("new").alias("new"))
    old, new = F.col("old"), F.col("new")
    counts = both.agg(F.count_if(old == 0).alias("newly"), F.count_if(new == 0).alias("no_longer"), F.count_if((old == 1) & (new == 1)).alias("still"))
    return counts.join(rounds[0]).join(rounds[1])


# A change is small under this share of the vertices, and warned of over these shares of unstable ones.
SMALL, UNSTABLE, VERY_UNSTABLE = 0.05, 0.30, 0.5


def compare(a: PropertyGraph, b: PropertyGraph) -> DataFrame:
    """One row on two versions of a graph: (nodes_old, nodes_new, added, removed, modified, pairs_added, pairs_removed, identical, stable,
    health_old, health_new, health_delta in ten-thousandths, unstable in ten-thousandths of the larger graph, coupling: low, high or critical, and
    impact() of all the vertices that changed). An empty graph has health 0."""
    changed, links = stored(nodes(a, b)), stored(pairs(a, b))
    of = lambda x: F.count_if(F.col("change") == x)
    out = a.vertices.agg(F.count("*").alias("nodes_old")).join(b.vertices.agg(F.count("*").alias("nodes_new")))
    out = out.join(changed.agg(of("added").alias("added"), of("removed").alias("removed"), of("modified").alias("modified")))
    out = out.join(links.agg(of("added").alias("pairs_added"), of("removed").alias("pairs_removed"))).join(stable_core(a, b, links).agg(F.count("*").alias("stable")))
    out = out.join(impact(a, b, changed))
    n, larger = F.col("added") + F.col("removed") + F.col("modified"), F.greatest("nodes_old", "nodes_new")
    part = lambda x, whole: F.when(whole > 0, F.round(x * 10000 / whole)).otherwise(0).cast("bigint")
    old, new = part(F.col("stable"), F.col("nodes_old")), part(F.col("stable"), F.col("nodes_new"))
    share = F.when(larger > 0, 1 - F.col("stable") / larger).otherwise(0.0)
    small = F.when(larger > 0, n / larger).otherwise(0.0) < SMALL
    level = F.when(small & (share > VERY_UNSTABLE), "critical").when(small & (share > UNSTABLE), "high").otherwise("low")
    return out.select(
        "nodes_old", "nodes_new", "added", "removed", "modified", "pairs_added", "pairs_removed", ((n == 0) & (F.col("pairs_added") + F.col("pairs_removed") == 0)).alias("identical"),
        "stable", old.alias("health_old"), new.alias("health_new"), (new - old).alias("health_delta"), part(larger - F.col("stable"), larger).alias("unstable"), level.alias("coupling"),
        "newly", "no_longer", "still", "depth_old", "depth_new",
    )
