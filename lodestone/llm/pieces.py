"""Windows of texts that stand in other texts too, found by minimum-substring partitioning.

Texts are packed into chunks. Each chunk sends the minimizers of its windows to buckets; a bucket sends back those that are
repeated. Each chunk then sends the distinct pieces of text under repeated minimizers, a bucket's kernel answers for every
window of them, and the chunk applies the answers. What is shuffled is a blob for each chunk and bucket that has something,
in a bounded number of rows for each chunk (common.met); identical pieces are sent once by a chunk and kept once by a bucket, so the inside of a passage that any number
of documents share is one piece. At its edges each document has its own: a minimizer with more than HOT_PIECES of them is
split, and each of its windows goes to a bucket by its own hash. Every intermediate table is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, jvm
from .common import answered, back, buckets, met, pack, unpack, written

#: Bytes of text in a chunk, and for each bucket.
CHUNK, BUCKET_BYTES = common.CHUNK_BYTES, 8 << 20
#: Distinct pieces of one minimizer, counted by chunk, beyond which its windows are dealt out one by one.
HOT_PIECES = 8 << 10


def removed(df: DataFrame, kernel: str, words: bool, span: int, gram: int, within: bool, id_col: str, text_col: str) -> DataFrame:
    """The rows of df, text_col replaced by: n_symbols, n_removed, kept_bytes (what is left), spans (removed runs, as pairs of int32)."""
    spark = df.sparkSession
    array = "array<binary>"
    anchors = jvm.register(spark, "lodestone_anchors", "Anchors", common.SENT)
    repeated = jvm.register(spark, "lodestone_repeated", "Repeated", array)
    send = jvm.register(spark, "lodestone_send_pieces", "SendPieces", common.SENT)
    match = jvm.register(spark, f"lodestone_{kernel.lower()}", kernel, array)
    cut = jvm.register(spark, "lodestone_cut_pieces", "CutPieces", "struct<kept:array<binary>, spans:array<binary>, n:array<bigint>, removed:array<bigint>>")

    chunks = pack(df, text_col, CHUNK)
    total, count = chunks.agg(F.sum(F.octet_length("texts")), F.count("*")).first()
    n = buckets(spark, total or 0, BUCKET_BYTES)
    how = F.lit(f"{int(words)},{span},{gram},{int(within)},{HOT_PIECES},{-(-n // common.RANGES)}")
    nb = F.lit(n)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n)

    def asked(sent: DataFrame, name: str, kernel: str) -> DataFrame:
        """Each bucket's blobs, in the order of their chunks, answered by one call; the answers, written."""
        got = met(sent, n, count, tasks).select("bucket", F.col("met.chunk").alias("chunks"), F.call_function(kernel, F.col("met.blob"), how).alias("answers"))
        return answered(got, n, count, name, written)

    twice = asked(chunks.select("chunk", F.call_function(anchors, "texts", "ends", how, nb).alias("sent")), "repeated", repeated)
    per_chunk = back(twice, n, tasks).select(F.col("chunk").alias("c_"), F.col("got.blob").alias("twice"))
    others = [c for c in df.columns if c != text_col]
    ids = F.transform("rows", lambda r: r[f"c{others.index(id_col)}"].cast("bigint"))
    with_twice = chunks.join(per_chunk, F.col("chunk") == F.col("c_"), "left").drop("c_")
    answers = asked(with_twice.where("twice is not null").select("chunk", F.call_function(send, "texts", "ends", how, nb, "twice", ids).alias("sent")), "answers", match)
    got = back(answers, n, tasks).select(F.col("chunk").alias("a_"), F.col("got.bucket").alias("buckets"), F.col("got.blob").alias("blobs"))
    whole = with_twice.join(got, F.col("chunk") == F.col("a_"), "left").drop("a_")
    out = whole.select("rows", F.call_function(cut, "texts", "ends", how, nb, "twice", ids, "buckets", "blobs").alias("x"))
    out = out.select("rows", F.col("x.kept").alias("kept"), F.col("x.spans").alias("spans"), F.col("x.n").alias("n"), F.col("x.removed").alias("removed"))
    return unpack(out, others, {"n_symbols": "n", "n_removed": "removed", "kept_bytes": "kept", "spans": "spans"})
