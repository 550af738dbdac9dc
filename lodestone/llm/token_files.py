"""Token counts of documents in flat, unindexed token files, by a scan for separators.

A file is a row of little-endian unsigned 16-bit ids (.u16; 32-bit ones, .u32, where a vocabulary needs them), with an
end-of-document id after each document and no index. Files are read in blocks, wherever those begin; a block reports the
places of its separators, and a prefix scan over the blocks of a file (a running maximum of the last place and a running
sum of their number, two figures for each block) stitches documents that cross any number of blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, ship, written

END_OF_DOCUMENT = 50256
FILE_TOKENS, BLOCK_TOKENS = 16 << 20, 1 << 20


def write(df: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", end: int = END_OF_DOCUMENT, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encodes every whole text (null: empty) and writes flat files of at most about file_tokens ids to the shared folder.
    Returns (path, tokens, ids: the documents in the file, in order). Document ids may be of any type, null or repeated. A
    task that runs twice writes other files; only those of the attempt that Spark commits are in the result. The end id
    must not be a token's."""
    if end in set(ranks.values()):
        raise ValueError("end: an id that no token has")
    width = 2 if max([end, *ranks.values()]) <= 0xFFFF else 4
    spark = df.sparkSession
    ship(spark)
    folder = scratch(spark, "tokens")
    shared = spark.sparkContext.broadcast((ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        tokens = tiktoken.Encoding("own", pat_str=shared.value[1], mergeable_ranks=shared.value[0], special_tokens={})
        out, name, ids, held, kind = None, "", [], 0, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([held], pa.int64()), pa.array([ids], pa.list_(kind))], names=["path", "tokens", "ids"])

        for batch in batches:
            kind = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.u{8 * width}"
                    out, ids, held = system.open_output_stream(f"{path}/{name}"), [], 0
                x = np.append(np.asarray(tokens.encode_ordinary(text or ""), dtype=np.int64), end).astype(f"<u{width}")
                out.write(x.tobytes())
                ids.append(doc)
                held += len(x)
                if held >= file_tokens:
                    out.close()
                    out = None
                    yield row()
        if out is not None:
            out.close()
            yield row()

    slim = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t"))
    return written(slim.mapInArrow(run, f"path string, tokens bigint, ids array<{slim.schema['id'].dataType.simpleString()}>"), "token-files")


def count(files: DataFrame, end: int = END_OF_DOCUMENT, block: int = BLOCK_TOKENS) -> DataFrame:
    """files (path, tokens: their number in it) → (path, ordinal, n_tokens): each document's tokens, without the separator,
    ordinals from 0. Two separators in a row are an empty document; tokens after the last one are a document too. Empty
    files, and an empty table, have none."""
    ship(files.sparkSession)
    blocks = files.where("tokens > 0").select("path", "tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tokens") - 1, F.lit(block).cast("bigint"))).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            at = []
            for path, tokens, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                system, inner = fs.FileSystem.from_uri(path)
                width = 4 if path.endswith(".u32") else 2
                with system.open_input_file(inner) as f:
                    f.seek(width * start)
                    x = np.frombuffer(f.read(width * min(block, tokens - start)), f"<u{width}")
                at.append((np.flatnonzero(x == end) + start).tolist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.list_(pa.int64()))], names=["path", "tokens", "start", "at"])

    found = written(blocks.repartition(F.col("path"), F.col("start")).mapInArrow(run, "path string, tokens bigint, start bigint, at array<bigint>"), "separators")
    # The scan sees two figures of a block, not its separators.
    slim = found.select("path", "start", F.size("at").alias("n"), F.element_at(F.when(F.size("at") > 0, F.col("at")), -1).alias("end"))
    blocks_in_order = Window.partitionBy("path").orderBy("start")
    before = blocks_in_order.rowsBetween(Window.unboundedPreceding, -1)
    slim = slim.select("path", "start", F.coalesce(F.max("end").over(before), F.lit(-1)).alias("last"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("done"), F.lead("start").over(blocks_in_order).isNull().alias("final"))
    scan = found.join(slim, ["path", "start"])
    # The end of the file ends the last document, unless a separator does.
    own = F.coalesce(F.element_at(F.when(F.size("at") > 0, F.col("at")), -1), F.col("last"))
    ends = F.when(F.col("final") & (own < F.col("tokens") - 1), F.concat("at", F.array("tokens"))).otherwise(F.col("at"))
    docs = scan.withColumn("ends", ends).select("path", "done", F.posexplode(F.transform(F.arrays_zip(F.col("ends").alias("e"), F.slice(F.concat(F.array("last"), "ends"), 1, F.size("ends")).alias("p")), lambda z: z["e"] - z["p"] - 1)).alias("i", "n_tokens"))
    return docs.select("path", (F.col("done") + F.col("i")).cast("bigint").alias("ordinal"), "n_tokens")


def count_documents(spark: SparkSession, df: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, path, ordinal) of every row of df: files are written, scanned, and named by their manifest."""
    files = write(df, ranks, pattern, id_col, text_col)
    named = files.select("path", F.posexplode("ids").alias("o", "id")).withColumn("ordinal", F.col("o").cast("bigint"))
    # By a shuffle: the manifest's files are small, but it has a row for each document, so it must not be broadcast.
    return named.hint("merge").join(count(files.select("path", "tokens")).hint("merge"), ["path", "ordinal"]).select(F.col("id").alias(id_col), "n_tokens", "path", "ordinal")
