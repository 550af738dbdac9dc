"""Helpers shared by the corpus operators: scratch space, packed chunks of documents, bucket counts."""

from __future__ import annotations

import atexit
import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, as a regular expression class; words are what lies between.
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of text that one packed chunk holds (a longer document makes a chunk of its own).
CHUNK_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


CLEANUP, WRITERS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.maxConcurrentOutputFileWriters"
#: Rows may be megabytes: a writer looks at its size after each, not after 100 of them, and a reader takes in a group at a time.
PARQUET = {"compression": "zstd", "parquet.page.size.row.check.min": "1", "parquet.block.size": str(16 << 20)}
#: Text of a bucket of chunks that are joined where they lie, and the most buckets that Spark makes.
PLACE_BYTES, MOST_PLACES = 64 << 20, 100_000
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each application."""
    if spark.sparkContext.applicationId in _shipped:
        return
    top = Path(__file__).parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="lodestone-py-"), "lodestone.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(spark.sparkContext.applicationId)


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where it is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir: name a folder that driver and executors share")
        root = getattr(scratch_root, "own", None)
        if root is None:
            root = scratch_root.own = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_made: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. It is removed when the driver's Python ends."""
    path = f"{scratch_root(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def freed(spark: SparkSession, keep: str) -> Iterator[None]:
    """Removes the scratch tables that the block has made, but for `keep`, when it ends without an error: what was to be made
    of them is written. Blocks of one process must not overlap."""
    first = len(_made)
    yield
    for at in range(len(_made) - 1, first - 1, -1):
        if _made[at][1] != keep:
            _remove(*_made.pop(at))


def removed(df: DataFrame) -> None:
    """Removes the table that df reads, one of written(), which nothing reads any more, so that later steps have its room."""
    for file in df.inputFiles()[:1]:
        for made in [m for m in _made if f"/{m[1].rsplit('/', 1)[1]}/" in file]:
            _remove(*made)
            _made.remove(made)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the session has ended
            return


def written(df: DataFrame, name: str, by: tuple[int, str] | None = None) -> DataFrame:
    """df, written to the shared folder and read again: cuts lineage and survives lost executors.

    by: (n, column) makes it a table of n buckets of that column, which a join on the column reads without a shuffle.
    Tasks write where they are; a task whose rows have few values of the column makes few files and sorts nothing.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    # The shuffle files of this job serve no other: Spark may remove them when it ends.
    with _set(spark, {CLEANUP: "true", WRITERS: "8"}):
        if by is None:
            df.write.options(**PARQUET).parquet(path)
            return spark.read.schema(df.schema).parquet(path)
        table = f"lodestone_{uuid.uuid4().hex}"
        df.write.bucketBy(*by).options(**PARQUET).option("path", path).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the name only: the files lie outside the warehouse, and out is resolved
    return out


_lock = threading.Lock()
_writes: list[dict[str, str | None]] = []


@contextmanager
def _set(spark: SparkSession, confs: dict[str, str]) -> Iterator[None]:
    """The session with these settings. They go back to what they were when the last of the writes that run at once ends."""
    with _lock:
        _writes.append(_writes[0] if _writes else {k: spark.conf.get(k, None) for k in confs})
        for k, v in confs.items():
            spark.conf.set(k, v)
    try:
        yield
    finally:
        with _lock:
            old = _writes.pop()
            for k, v in old.items() if not _writes else ():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint(); its files are scratch like others, and removed with them."""
    spark = df.sparkSession
    scratch_root(spark)
    out = df.checkpoint()
    file = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        _made.append((spark, file.get()))
    return out


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join that is never a broadcast. The planner takes what a generator makes of a row for one row, so it would
    send tables to the driver that are many times the size it expects."""
    return df.hint("merge")


def buckets(spark: SparkSession, total_bytes: int, per_bucket: int) -> int:
    """Buckets of a hash shuffle: as many as the session's partitions, more where the data need them."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total_bytes // per_bucket))


Made = Callable[[list, pa.StructArray], dict[str, pa.Array]]


def pack(df: DataFrame, text_col: str, chunk_bytes: int = CHUNK_BYTES, places: int | None = None, made: tuple[Made, str] | None = None) -> DataFrame:
    """Rows of df packed into chunks of about chunk_bytes of text, without a shuffle, and written to the shared folder.

    chunk: an id; rows: the other columns, by place (c0, c1, ...); ids of rows are positions in it; texts: the UTF-8 texts one
    after the other; ends: where each ends (little-endian int32); nulls: a byte for each row, 1 where the text is null.
    Later steps refer to (chunk, position), so repeated or null keys and clashing column names do no harm.

    made: a function of a chunk's texts and rows, and the DDL of the columns that it gives, which stand for the last three.
    places: the table has so many buckets of `part`, the task that made a chunk (its id's upper half); see answers_of().
    """
    ship(df.sparkSession)
    others = [c for c in df.columns if c != text_col]
    slim = df.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)] or [F.lit(0).alias("c0")]).alias("o"), F.col(f"`{text_col}`").cast("binary").alias("t"))
    make, ddl = made or (_plain, "texts binary, ends binary, nulls binary")
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("rows", T.ArrayType(slim.schema["o"].dataType)), *T.StructType.fromDDL(ddl)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        others_held, texts_held, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal n, held
            o = pa.concat_arrays(others_held)
            cols = make([t for a in texts_held for t in a], o)
            out = pa.RecordBatch.from_arrays([pa.array([part << 32 | n], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(o)], pa.int32()), o), *cols.values()], names=["chunk", "rows", *cols])
            n, held = n + 1, 0
            others_held.clear()
            texts_held.clear()
            return out

        for batch in batches:
            o, texts = batch.column(0), batch.column(1).to_pylist()
            first = 0
            for i, t in enumerate(texts):
                size = len(t or b"") + 16
                if held and held + size > chunk_bytes:
                    if i > first:
                        others_held.append(o.slice(first, i - first))
                        texts_held.append(texts[first:i])
                    first = i
                    yield flush()
                held += size
            if first < len(texts):
                others_held.append(o.slice(first))
                texts_held.append(texts[first:])
        if others_held:
            yield flush()

    out = slim.mapInArrow(run, schema)
    if places is None:
        return written(out, "chunks")
    return written(out.withColumn("part", part()), "chunks", (places, "part"))


def _plain(texts: list[bytes | None], rows: pa.StructArray) -> dict[str, pa.Array]:
    ends = np.cumsum([0 if t is None else len(t) for t in texts], dtype=np.int32)
    return {"texts": pa.array([b"".join(t or b"" for t in texts)], pa.binary()), "ends": pa.array([ends.astype("<i4").tobytes()], pa.binary()), "nulls": pa.array([bytes(t is None for t in texts)], pa.binary())}


def part() -> Column:
    """The task that made a chunk."""
    return F.shiftright("chunk", 32).cast("int")


def places_of(spark: SparkSession, total_bytes: int) -> int:
    """Buckets for chunks of so much text: they change how work is dealt out, never the result."""
    return min(MOST_PLACES, buckets(spark, total_bytes, PLACE_BYTES))


# The exchange between chunks and buckets. Both grow with the text, so a row for each pair of them would grow with its square.
# A chunk sends RANGES rows at most; with more buckets than that a row holds those of a range, and goes to its bucket in two
# steps, of which the first brings together what many chunks have for one bucket. Answers go the same way back.

#: Most rows that a chunk sends, and the chunks whose rows for one range meet in the first of two steps.
RANGES, GROUP = 2048, 4096
#: What a chunk sends: its blobs for buckets, by range.
SENT = "array<struct<range:int, parts:array<struct<bucket:int, blob:binary>>>>"


def in_ranges(found: list[tuple[int, bytes]], n: int) -> list[dict]:
    """(bucket, blob) by bucket → a value of SENT."""
    out: list[dict] = []
    width = -(-n // RANGES)
    for b, blob in found:
        if not out or out[-1]["range"] != b // width:
            out.append({"range": b // width, "parts": []})
        out[-1]["parts"].append({"bucket": b, "blob": blob})
    return out


def sent_array(found: list[tuple[int, bytes]], n: int) -> pa.Array:
    part_ = pa.struct([("bucket", pa.int32()), ("blob", pa.binary())])
    return pa.array([in_ranges(found, n)], pa.list_(pa.struct([("range", pa.int32()), ("parts", pa.list_(part_))])))


def _group(chunks: int) -> Column:
    return F.pmod(F.xxhash64("chunk"), F.lit(-(-chunks // GROUP))).cast("int")


def met(sent: DataFrame, n: int, chunks: int, tasks: int) -> DataFrame:
    """sent (chunk, sent: of SENT) → (bucket, met: structs of chunk and blob, in the order of chunks), for n buckets.

    Buckets go to tasks by their number, not its hash, by which the fullest task would have the more of them the more there are."""
    rows = sent.select("chunk", F.explode("sent").alias("s")).select("chunk", "s.range", "s.parts")
    one = lambda df, *keys: df.select("chunk", *keys, F.explode("parts").alias("p")).select("chunk", *keys, "p.bucket", "p.blob")
    pair = F.struct("chunk", "blob")
    if n <= RANGES:
        return one(rows).repartitionById(tasks, "bucket").groupBy("bucket").agg(F.array_sort(F.collect_list(pair)).alias("met"))
    near = one(rows.withColumn("g", _group(chunks)).repartition(tasks, "range", "g"), "range", "g")
    near = near.groupBy("range", "g", "bucket").agg(F.collect_list(pair).alias("m"))
    return near.repartitionById(tasks, "bucket").groupBy("bucket").agg(F.array_sort(F.flatten(F.collect_list("m"))).alias("met"))


def answered(answers: DataFrame, n: int, chunks: int, name: str, write=written, extra: tuple[str, ...] = ()) -> DataFrame:
    """answers (bucket, chunks, answers: a blob for each, and extra columns, which stay in the first row of a bucket) →
    the same as rows for back(), written."""
    out = answers.select("bucket", F.posexplode(F.arrays_zip("chunks", "answers")).alias("i", "a"), *extra)
    first = [F.when(F.col("i") == 0, F.col(c)).alias(c) for c in extra]
    out = out.select("bucket", F.col("a.chunks").alias("chunk"), F.col("a.answers").alias("blob"), *first)
    out = out.where((F.octet_length("blob") > 0) | (F.coalesce(*[F.col(c).isNotNull() for c in extra]) if extra else F.lit(False)))
    if n > RANGES:
        out = out.groupBy("bucket", _group(chunks).alias("g")).agg(F.collect_list(F.struct("chunk", "blob")).alias("m"), *[F.first(c, ignorenulls=True).alias(c) for c in extra])
    return write(out, name)


def back(rows: DataFrame, n: int, tasks: int, places: int | None = None) -> DataFrame:
    """rows of answered() → (chunk, got: structs of bucket and blob), in so many tasks, or what a task holds would grow with the
    input. places: dealt out by part, for answers_of()."""
    pair = F.struct("bucket", "blob")
    if n > RANGES:
        width = -(-n // RANGES)
        rows = rows.withColumn("range", F.floor(F.col("bucket") / width).cast("int")).repartition(tasks, "range", "g")
        rows = rows.select("range", "g", "bucket", F.explode("m").alias("x")).select("range", "g", "bucket", "x.chunk", "x.blob")
        rows, got = rows.groupBy("range", "g", "chunk").agg(F.collect_list(pair).alias("m")), F.flatten(F.collect_list("m"))
    else:
        got = F.collect_list(pair)
    if places is None:
        return rows.repartition(tasks, "chunk").groupBy("chunk").agg(got.alias("got"))
    return rows.withColumn("p_", part()).repartition(places, "p_").groupBy("p_", F.col("chunk").alias("c_")).agg(got.alias("got"))


def answers_of(chunks: DataFrame, per: DataFrame) -> DataFrame:
    """chunks (packed with places) and `got` of back() with the same places for each. Only answers are shuffled.

    The buckets are of `part`, so that alone is a key of the join; the chunk is compared in a form that is no second key.
    """
    return chunks.join(per.hint("shuffle_hash"), (F.col("part") == F.col("p_")) & (F.col("chunk") - F.col("c_") == 0), "left").drop("p_", "c_")


def unpack(df: DataFrame, others: list[str], results: dict[str, str]) -> DataFrame:
    """A row for each position of a chunk again: the first columns in rows, whose names are `others`, but for those that are
    also names of results, then the results (name: array column of df)."""
    zipped = df.select(F.explode(F.arrays_zip(F.col("rows").alias("r_"), *[F.col(c).alias(f"x{i}_") for i, c in enumerate(results.values())])).alias("z"))
    keep = [F.col("z.r_").getField(f"c{i}").alias(c) for i, c in enumerate(others) if c not in results]
    return zipped.select(*keep, *[F.col(f"z.x{i}_").alias(n) for i, n in enumerate(results)])
