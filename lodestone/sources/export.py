"""Exports of a graph: wide rows of vertices and edges with what is known of each, as JSON lines, and keyed results that are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..operators import classify, reports


def view_nodes(g: PropertyGraph, stages: DataFrame | None = None, covered: DataFrame | None = None, inputs: tuple[str, ...] = (), outputs: tuple[str, ...] = (), critical: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """Every vertex with its class, its risk by degrees and marks; with stages (id, stage) and covered (name, has_sva, has_cov)
    if given. most: that many by id, a limit that its caller asks for."""
    v = g.vertices.select("id", "name", "module", "kind", F.greatest(F.lit(0), F.col("width_msb") - F.col("width_lsb") + 1).cast("bigint").alias("width"), "is_clock", "is_reset", "is_enable", "is_port")
    out = v.join(classify.nodes(g), "id").join(reports.degree_score(g).select("id", "score", F.col("bucket").alias("risk")), "id")
    if stages is not None:
        out = out.join(stages.select("id", "stage"), "id", "left")
    if covered is not None:
        out = out.withColumn("b_", F.substring_index("id", ".", -1)).join(covered.select(F.col("name").alias("b_"), "has_sva", "has_cov"), "b_", "left").drop("b_").na.fill(False, ["has_sva", "has_cov"])
    for name, ids in (("is_input", inputs), ("is_output", outputs), ("is_critical", critical)):
        out = out.withColumn(name, F.col("id").isin(*ids) if ids else F.lit(False))
    return out if most is None else out.orderBy("id").limit(most)


def view_edges(g: PropertyGraph, expressions: bool = True, conditions: bool = True, most: int | None = None) -> DataFrame:
    """Every edge, parallel ones too, with its class; without expressions or conditions (and clocks) these are null."""
    key = ["src", "dst", "kind", "condition"]
    cls = classify.edges(g).select(*key, "class", "key_control").distinct()
    e = g.edges.join(cls, key, "left").withColumn("is_control", F.col("class") == "CONTROL")
    keep = lambda c, yes: F.col(c) if yes else F.lit(None).cast("string").alias(c)
    out = e.select(F.concat_ws("->", "src", "dst").alias("id"), "src", "dst", "kind", "assign_type", "class", "key_control", "is_control", keep("expression", expressions), keep("condition", conditions), keep("clock_domain", conditions))
    return out if most is None else out.orderBy("src", "dst", "kind", "condition").limit(most)


def json_lines(df: DataFrame) -> DataFrame:
    """A JSON object for each row; absent values (null, empty text, empty lists) are left out, 0 and false stay."""
    text = {f.name for f in df.schema if f.dataType.typeName() == "string"}
    lists = {f.name for f in df.schema if f.dataType.typeName() in ("array", "map")}

    def cell(c: str) -> Column:
        return (F.nullif(F.col(c), F.lit("")) if c in text else F.when(F.size(c) > 0, F.col(c)) if c in lists else F.col(c)).alias(c)

    return df.select(F.to_json(F.struct(*[cell(c) for c in df.columns])).alias("value"))


def write_view(g: PropertyGraph, path: str, **options) -> None:
    """The export of a whole graph under path: nodes and edges as JSON lines, and one line of totals."""
    json_lines(view_nodes(g, **options)).write.mode("overwrite").text(f"{path}/nodes")
    json_lines(view_edges(g)).write.mode("overwrite").text(f"{path}/edges")
    counts = g.vertices.agg(F.count("*").alias("node_count")).join(g.edges.agg(F.count("*").alias("edge_count")))
    json_lines(counts).write.mode("overwrite").text(f"{path}/meta")


def _key(key: str) -> str:
    if not key or not all(c.isalnum() or c in "._-" for c in key) or set(key) == {"."}:
        raise ValueError(f"not a key: {key!r}")
    return key


def keep(df: DataFrame, root: str, key: str) -> None:
    """Writes a result under its key (such as text.source_hash()), in place of what is there."""
    df.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{_key(key)}")


def _path(spark: SparkSession, place: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(place)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def kept(spark: SparkSession, root: str, key: str) -> DataFrame | None:
    """The result of a key, or None if there is none that was written to its end."""
    place = f"{root.rstrip('/')}/{_key(key)}"
    done, fs = _path(spark, f"{place}/_SUCCESS")
    return spark.read.parquet(place) if fs.exists(done) else None


def forget(spark: SparkSession, root: str, key: str | None = None) -> bool:
    """Removes the result of a key, or all that are under root."""
    p, fs = _path(spark, root if key is None else f"{root.rstrip('/')}/{_key(key)}")
    return fs.delete(p, True)


def kept_stats(spark: SparkSession, root: str) -> DataFrame:
    """(keys, files, bytes) under root."""
    p, fs = _path(spark, root)
    if not fs.exists(p):
        return spark.createDataFrame([(0, 0, 0)], "keys bigint, files bigint, bytes bigint")
    found = fs.getContentSummary(p)
    return spark.createDataFrame([(len(fs.listStatus(p)), found.getFileCount(), found.getLength())], "keys bigint, files bigint, bytes bigint")
