"""Snapshots of graphs: lossless Parquet by tag, and the JSON document that other tools exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..graph import PropertyGraph
from ..operators import diff

NODE = "id string, name string, module string, kind string, width array<int>, bit_range string, file string, line int, is_clock boolean, is_reset boolean, is_enable boolean, is_port boolean, parent string"
EDGE = "src string, dst string, kind string, assign_type string, condition string, clock_domain string, modport_dir string, confidence string"
DOCUMENT = f"version string, created_at string, tag string, git_commit string, node_count int, edge_count int, nodes array<struct<{', '.join(f.replace(' ', ':', 1) for f in NODE.split(', '))}>>, edges array<struct<{', '.join(f.replace(' ', ':', 1) for f in EDGE.split(', '))}>>"


def _place(root: str, tag: str, part: str) -> str:
    return f"{root.rstrip('/')}/{part}/tag={tag}"


def save(g: PropertyGraph, root: str, tag: str, commit: str = "") -> None:
    """Writes the graph under its tag, in place of what is there."""
    g.vertices.write.mode("overwrite").parquet(_place(root, tag, "vertices"))
    g.edges.write.mode("overwrite").parquet(_place(root, tag, "edges"))
    meta = g.vertices.agg(F.count("*").alias("node_count")).join(g.edges.agg(F.count("*").alias("edge_count"))).withColumn("git_commit", F.lit(commit)).withColumn("created_at", F.current_timestamp())
    meta.write.mode("overwrite").parquet(_place(root, tag, "meta"))


def load(spark: SparkSession, root: str, tag: str) -> PropertyGraph:
    return PropertyGraph(spark.read.schema(schema.VERTICES).parquet(_place(root, tag, "vertices")), spark.read.schema(schema.EDGES).parquet(_place(root, tag, "edges")))


def tags(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/meta").select("tag", "node_count", "edge_count", "git_commit", "created_at")


def compare(spark: SparkSession, root: str, old: str, new: str) -> DataFrame:
    """diff.compare() of the graphs of two tags."""
    return diff.compare(load(spark, root, old), load(spark, root, new))


def delete(spark: SparkSession, root: str, tag: str) -> bool:
    done = False
    for part in ("vertices", "edges", "meta"):
        p = spark._jvm.org.apache.hadoop.fs.Path(_place(root, tag, part))
        done |= p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return done


def parse(documents: DataFrame, json_col: str = "value") -> PropertyGraph:
    """Graph of JSON documents. Unknown kinds become SIGNAL and DRIVER; absent fields get defaults."""
    d = documents.select(F.from_json(json_col, DOCUMENT).alias("d"))
    n = d.select(F.inline("d.nodes"))
    n = n.withColumn("width_msb", F.get("width", F.lit(0))).withColumn("width_lsb", F.get("width", F.lit(1))).withColumn("kind", F.when(F.col("kind").isin(*schema.VERTEX_KINDS), F.col("kind")).otherwise("SIGNAL"))
    e = d.select(F.inline("d.edges")).withColumn("kind", F.when(F.col("kind").isin(*schema.EDGE_KINDS), F.col("kind")).otherwise("DRIVER"))
    return PropertyGraph.of(n, e)


def read_json(spark: SparkSession, path: str) -> PropertyGraph:
    return parse(spark.read.text(path, wholetext=True))


def document(g: PropertyGraph, tag: str = "", version: str = "1.0") -> DataFrame:
    """One JSON document of a whole graph, for small graphs: it is one row."""
    n = g.vertices.select(F.struct("id", "name", "module", "kind", F.array("width_msb", "width_lsb").alias("width"), "is_clock", "is_reset", "is_enable", "is_port").alias("x")).agg(F.array_sort(F.collect_list("x")).alias("nodes"))
    e = g.edges.select(F.struct("src", "dst", "kind", "assign_type", "condition", "clock_domain").alias("x")).agg(F.array_sort(F.collect_list("x")).alias("edges"))
    return n.join(e).select(F.to_json(F.struct(F.lit(version).alias("version"), F.lit(tag).alias("tag"), F.size("nodes").alias("node_count"), F.size("edges").alias("edge_count"), "nodes", "edges")).alias("value"))
