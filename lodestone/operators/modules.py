"""Neighbours and module boundaries: equi, semi and anti joins of edges with vertices."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import PropertyGraph


def drivers(g: PropertyGraph, id: str) -> DataFrame:
    near = g.edges.where(F.col("dst") == id).select(F.col("src").alias("id")).distinct()
    return g.vertices.join(near, "id", "left_semi")


def loads(g: PropertyGraph, id: str) -> DataFrame:
    near = g.edges.where(F.col("src") == id).select(F.col("dst").alias("id")).distinct()
    return g.vertices.join(near, "id", "left_semi")


def by_kind(g: PropertyGraph, kind: str) -> DataFrame:
    """(id, n_in, n_out): edges of one kind at every vertex that has one."""
    e = g.edges.where(F.col("kind") == kind)
    ends = e.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(e.select("dst", F.lit(1), F.lit(0)))
    return ends.groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def placed(g: PropertyGraph) -> DataFrame:
    """Edges with the modules of both ends."""
    m = g.vertices.select("id", "module")
    return g.edges.join(m.select(F.col("id").alias("src"), F.col("module").alias("src_module")), "src").join(m.select(F.col("id").alias("dst"), F.col("module").alias("dst_module")), "dst")


def internal(g: PropertyGraph, module: str) -> DataFrame:
    return placed(g).where((F.col("src_module") == module) & (F.col("dst_module") == module))


def crossing(g: PropertyGraph, module: str) -> DataFrame:
    return placed(g).where((F.col("src_module") == module) != (F.col("dst_module") == module))


def connected(g: PropertyGraph, module: str) -> DataFrame:
    other = F.when(F.col("src_module") == module, F.col("dst_module")).otherwise(F.col("src_module"))
    return crossing(g, module).select(other.alias("module")).distinct()


def unconnected_ports(g: PropertyGraph) -> DataFrame:
    ends = g.edges.select(F.col("src").alias("id")).union(g.edges.select("dst"))
    return g.vertices.where("is_port").join(ends, "id", "left_anti")


def shared_net_pairs(ports: DataFrame, per_net: int = 4) -> DataFrame:
    """ports (instance, net) → (net, a, b): pairs a < b on one net, the first per_net of each net, which is the operator's
    own limit. A net with many instances gives each instance its next neighbours only, so no net is squared."""
    order = Window.partitionBy("net").orderBy("instance")
    ranked = ports.select("instance", "net").distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_net + 1)
    a, b = ranked.select("net", F.col("instance").alias("a"), F.col("r").alias("ra")), ranked.select(F.col("net").alias("n2"), F.col("instance").alias("b"), F.col("r").alias("rb"))
    pairs = a.join(b, (F.col("net") == F.col("n2")) & (F.col("ra") < F.col("rb"))).drop("n2")
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("net").orderBy("a", "b"))).where(F.col("rank") <= per_net).select("net", "a", "b")


def filtered(df: DataFrame, kinds: tuple[str, ...] = (), module: str | None = None, width_min: int | None = None, width_max: int | None = None, exclude: str | None = None) -> DataFrame:
    """Vertices by kind, module glob (constants pass), width and excluded id glob: * is any text, ? any character, all else itself."""
    glob = lambda p: "^" + "".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in p) + "$"
    width = F.greatest(F.lit(0), F.col("width_msb") - F.col("width_lsb") + 1)
    if kinds:
        df = df.where(F.col("kind").isin(*kinds))
    if module:
        df = df.where((F.col("kind") == "CONST") | F.col("module").rlike(glob(module)))
    if width_min is not None:
        df = df.where(width >= width_min)
    if width_max is not None:
        df = df.where(width <= width_max)
    return df.where(~F.col("id").rlike(glob(exclude))) if exclude else df
