"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`. No stage
can be stated in SQL as a whole (a fitted classifier, linked components, tokens), so ORACLE_SQL is None; tests compare the
pipeline with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontaminate, langid, simhash, suffix_dedup
from lodestone.llm.common import freed, read, scratch
from lodestone.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language the classifier doesn't reject: null texts, texts without a letter, and those too
    far from every centroid go."""
    docs = docs.select(*COLUMNS)
    model = langid.fit(docs)
    return langid.predict(docs, model).where("not lang_rejected").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group, the one with the smallest id (nulls last), ties as keep_one() states."""
    return simhash.keep_one(docs.select(*COLUMNS))


def repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes 50-byte strings that an earlier document has out of the texts; a document of which nothing is left goes."""
    out = suffix_dedup.deduplicate(docs.select(*COLUMNS))
    text = F.when(F.col("n_removed") == 0, F.col("kept_bytes").cast("string")).otherwise(suffix_dedup.as_text(spark, F.col("kept_bytes")))
    out = out.where((F.col("n_removed") == 0) | (F.octet_length("kept_bytes") > 0)).select("doc_id", text.alias("text"), "lang", "source")
    return out.select("doc_id", "text", "lang", "source", F.char_length("text").cast("bigint").alias("n_chars"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that are contaminated by `benchmark`, by the verdict on their own text: null and repeated ids do no
    harm, null and empty texts stay."""
    docs = docs.select(*COLUMNS)
    return decontaminate.remove(docs, decontaminate.scan(docs, read(spark, sf_dir, "benchmark")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text (null: none), and whether decoding them gives the text's bytes again; a row for every row."""
    docs = docs.select("doc_id", "text", "lang", "source").withColumn("sha_", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    out = bpe.encode(docs, *vocabulary())
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), (F.sha2("decoded", 256) == F.col("sha_")).alias("round_trip"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_bytes", repeated_bytes), ("decontaminated", decontaminated), ("tokens", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The stages over `documents`, each written and read again; what a stage made on the way is removed once it is written.
    With a folder, stages that an earlier run has finished there are taken as they are."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}" if folder else scratch(spark, f"pipeline-{name}")
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            with freed(spark, path):
                stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
