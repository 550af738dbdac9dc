"""SimHash near-duplicates, found by meet-in-the-middle ball hashing."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jvm
from .common import checkpointed, shuffled
from .components import components


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp): the 64-bit SimHash of every whole text. Null, empty and blank texts have fingerprint zero."""
    f = jvm.register(df.sparkSession, "lodestone_simhash", "SimHash", "bigint")
    return df.select(F.col(f"`{id_col}`").alias(id_col), F.call_function(f, F.col(f"`{text_col}`").cast("binary")).alias("fp"))


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """fps (fp, distinct) → (a, b): enough verified pairs within radius bits that every chain of links is kept.

    Each fingerprint emits every variant within half the radius; two within the radius meet in one at least. All that
    meet in a variant are compared with the least of them, which for an even radius is within it of every other, so
    no pairs within a group are formed; a variant meets a bounded number of distinct fingerprints. A null fp links to none.
    """
    if radius < 0 or radius % 2:
        raise ValueError("radius: an even number of bits")
    masks = [0] + [sum(1 << b for b in c) for n in range(1, radius // 2 + 1) for c in combinations(range(64), n)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    # Dealt out by number, or few small partitions would each make 65 times their rows; and by another expression than fp, by
    # which fps may be dealt out already, or the planner would take this exchange for needless.
    spread = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))
    variants = spread.select("fp", F.explode(F.transform(F.array(*[F.lit(m).cast("bigint") for m in masks]), lambda m: F.col("fp").bitwiseXOR(m))).alias("v"))
    met = variants.groupBy("v").agg(F.min("fp").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = variants.join(shuffled(met), "v").where("fp != low").select(F.col("low").alias("a"), F.col("fp").alias("b"))
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def classes(fps: DataFrame, radius: int = 2) -> DataFrame:
    """fps (fp, distinct) → (fp, label, n_links): label is the least fingerprint that links of at most radius bits reach."""
    edges = checkpointed(links(fps, radius))
    degree = edges.select(F.col("a").alias("fp")).union(edges.select(F.col("b").alias("fp"))).groupBy("fp").agg(F.count("*").alias("n_links"))
    labels = components(edges).withColumnRenamed("node", "fp")
    return fps.join(shuffled(labels), "fp", "left").join(shuffled(degree), "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """(id_col, fingerprint as 16 hex digits, component_id, n_links): the near-duplicate classes of the rows of df.

    component_id is the smallest id reachable over links of at most radius differing bits; n_links counts the distinct
    fingerprints recorded as linked to the document's own in the star form. Null ids are rows like others, but never
    name a component unless it has no other id. Repeated rows come out repeated. Other columns of df are ignored, so
    clashing names do no harm.
    """
    fps = checkpointed(fingerprints(df, id_col, text_col).withColumnRenamed(id_col, "id"))
    distinct = fps.groupBy("fp").agg(F.min("id").alias("id"))
    found = distinct.join(shuffled(classes(distinct.select("fp"), radius)), "fp")
    named = found.groupBy("label").agg(F.min("id").alias("component_id"))
    of = found.join(shuffled(named), "label").select("fp", "component_id", "n_links")
    return fps.join(shuffled(of), "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """The rows of df, one for each near-duplicate class: the first by id (nulls last), then by the text's SHA-256 (null
    texts first), then by the other columns as JSON; of rows that are equal in all one stays. Ids may be null or repeated:
    they never join classes. An empty df gives no rows."""
    from pyspark.sql import Window

    sha = F.coalesce(F.sha2(F.col(f"`{text_col}`").cast("binary"), 256), F.lit(""))
    f = jvm.register(df.sparkSession, "lodestone_simhash", "SimHash", "bigint")
    rows = checkpointed(df.select(F.col(f"`{id_col}`").alias("id"), sha.alias("sha"), F.call_function(f, F.col(f"`{text_col}`").cast("binary")).alias("fp")))
    first = rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "sha")).alias("first"))
    found = first.join(shuffled(classes(first.select("fp"), radius)), "fp")
    kept = found.groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.id").alias("id"), F.col("first.sha").alias("sha"))
    # Id and text name a row's class: a text has one fingerprint, whatever other rows bear its id.
    place = {c: f"c{i}" for i, c in enumerate(df.columns)}
    named = df.select(*[F.col(f"`{c}`").alias(n) for c, n in place.items()], sha.alias("own"))
    out = named.join(shuffled(kept), named[place[id_col]].eqNullSafe(kept["id"]) & (F.col("own") == F.col("sha")), "left_semi")
    # Texts are shuffled once more only if there are rows that are equal in both.
    if rows.groupBy("id", "sha").count().where("count > 1").limit(1).count():
        order = Window.partitionBy(place[id_col], "own").orderBy(F.to_json(F.struct(*place.values())))
        out = out.withColumn("rank", F.row_number().over(order)).where("rank = 1")
    return out.select(*[F.col(n).alias(c) for c, n in place.items()])
