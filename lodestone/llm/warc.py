"""Merkle fixity audit of WARC replicas: trees over ordered records, compared from the root down where they differ.

A replica is a table of its records (layout() of pages, or read() of WARC files): file, ordinal, offset, length, id, digest.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, scratch, ship, written

#: Children of a node of a tree; records of a file; files that records without an id are dealt to.
FAN, FILE_RECORDS, NAMELESS = 16, 512, 1 << 20
READ_BYTES = 1 << 20
LEAF = "file bigint, ordinal bigint, offset bigint, length bigint, id bigint, digest string"


def record(id: Column, url: Column, payload: Column) -> Column:
    """A response record in WARC/1.0 form, as binary. Null parts are empty."""
    body = F.coalesce(payload, F.lit("")).cast("binary")
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def _records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, file_records: int) -> DataFrame:
    """(file, id, record): the file of a null id goes by the url, or without one by the record, so that no file gathers them."""
    id, url = F.col(f"`{id_col}`").cast("bigint"), F.col(f"`{url_col}`")
    r = record(id, url, F.col(f"`{payload_col}`"))
    return pages.select(id.alias("id"), url.alias("url"), r.alias("record")).select(
        F.coalesce(F.floor(F.col("id") / file_records), -1 - F.pmod(F.xxhash64("url"), F.lit(NAMELESS)) - F.when(F.col("url").isNull(), NAMELESS + F.pmod(F.xxhash64("record"), F.lit(NAMELESS))).otherwise(0)).cast("bigint").alias("file"), "id", "record")


def layout(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", file_records: int = FILE_RECORDS) -> DataFrame:
    """(file, ordinal, offset, length, id, digest): where each record of pages stands, and the SHA-256 of its bytes.

    Files take file_records ids each, and records follow one another by id, ties by digest. Ids are integers, or raise in the
    cast; records with a null id are dealt to files below 0, by url. Repeated rows are records of their own. An empty table
    has no records. Other columns are ignored.
    """
    out = _records(pages, id_col, url_col, payload_col, file_records).select("file", "id", F.octet_length("record").cast("bigint").alias("length"), F.sha2("record", 256).alias("digest"))
    order = Window.partitionBy("file").orderBy("id", "digest")
    return out.select("file", (F.row_number().over(order) - 1).cast("bigint").alias("ordinal"), (F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("offset"), "length", "id", "digest")


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", file_records: int = FILE_RECORDS) -> DataFrame:
    """Writes the records of pages, as layout() places them, to .warc.gz files in the shared folder, each record a member of
    its own. Returns (file, path). A task that runs twice writes other files; those of the attempt that Spark commits are
    in the result."""
    ship(pages.sparkSession)
    folder = scratch(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        out, now, name = None, None, ""

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([f"{folder}/{name}"])], names=["file", "path"])

        for batch in batches:
            for file, bytes_ in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if out is None or file != now:
                    if out is not None:
                        out.close()
                        yield row()
                    now, name = file, f"{file}-{uuid.uuid4().hex}.warc.gz"
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                z = zlib.compressobj(1, wbits=31)
                out.write(z.compress(bytes_.as_py()) + z.flush())
        if out is not None:
            out.close()
            yield row()

    rows = _records(pages, id_col, url_col, payload_col, file_records).withColumn("digest", F.sha2("record", 256))
    rows = rows.repartition("file").sortWithinPartitions("file", "id", "digest").select("file", "record")
    return written(rows.mapInArrow(run, "file bigint, path string"), "warc-files")


def members(f) -> Iterator[tuple[bytes, bool]]:
    """The gzip members of an open file, unpacked, and true; or the bytes of one that can't be unpacked, up to the next that
    may begin, and false. What is held is one member."""
    rest = b""
    while rest := rest or f.read(READ_BYTES):
        z, out, raw, left = zlib.decompressobj(31), [], [], rest
        try:
            while not z.eof:
                left = left or f.read(READ_BYTES)
                if not left:
                    raise zlib.error("cut short")
                raw.append(left)
                out.append(z.decompress(left))
                left = z.unused_data
            rest = left
            yield b"".join(out), True
        except zlib.error:
            held = b"".join(raw)
            at = held.find(b"\x1f\x8b\x08", 1)
            while at < 0 and (more := f.read(READ_BYTES)):
                at = max(1, len(held) - 2)
                held += more
                at = held.find(b"\x1f\x8b\x08", at)
            rest = held[at:] if at > 0 else b""
            yield held[:at] if at > 0 else held, False


def read(files: DataFrame) -> DataFrame:
    """files (file, path of a .warc.gz file) → the records that stand in them, as layout() gives them: offsets and lengths are
    those of the unpacked file. A member that can't be unpacked, or has no record id, is a record with a null id."""
    ship(files.sparkSession)
    name = re.compile(rb"\r\nWARC-Record-ID: <urn:page:(-?\d+)>\r\n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for file, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, inner = fs.FileSystem.from_uri(path)
                rows, offset = [], 0
                with system.open_input_file(inner) as f:
                    for n, (x, whole) in enumerate(members(f)):
                        found = name.search(x, 0, max(0, x.find(b"\r\n\r\n") + 2)) if whole else None
                        rows.append((file, n, offset, len(x), int(found[1]) if found else None, hashlib.sha256(x).hexdigest()))
                        offset += len(x)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], names=["file", "ordinal", "offset", "length", "id", "digest"])

    return files.select("file", "path").repartition(F.xxhash64("path")).mapInArrow(run, LEAF)


def _levels(leaves: DataFrame, height: int, fan: int) -> list[DataFrame]:
    """Levels of the trees above the leaves: (file, node, hash, low, high). A node's hash covers its children's, in order, and
    the range of offsets below it. Each level is kept, so no level is computed from the records again."""
    now = leaves.select("file", F.col("ordinal").alias("node"), F.sha2(F.concat_ws("|", "offset", "length", "digest"), 256).alias("hash"), F.col("offset").alias("low"), (F.col("offset") + F.col("length")).alias("high"))
    out = []
    for _ in range(height):
        grouped = now.groupBy("file", F.floor(F.col("node") / fan).alias("node")).agg(F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("c"), F.min("low").alias("low"), F.max("high").alias("high"))
        now = checkpointed(grouped.select("file", "node", F.sha2(F.concat_ws("|", F.col("c.hash"), F.col("low").cast("string"), F.col("high").cast("string")), 256).alias("hash"), "low", "high"))
        out.append(now)
    return out


def audit(a: DataFrame, b: DataFrame, fan: int = FAN) -> DataFrame:
    """Two replicas → (file, ordinal, id, status) of the records that differ; ordinals of `extra` ones are b's.

    Roots are compared first, and a level below is looked at only under nodes that differ, so equal files cost one comparison.
    The records under the lowest nodes that differ are met by id and digest, equal ones in order: those that stand elsewhere
    in b are `moved`. What is left is met by id, in order: `changed` if b has the id, else `missing`, or `extra` (in b only).
    A null id is an id like others, whose records are met in order. An empty replica makes all of the other's missing or extra.
    """
    a, b = checkpointed(a), checkpointed(b)
    most = a.select("ordinal").union(b.select("ordinal")).agg(F.max("ordinal")).first()[0] or 0
    height = 1
    while fan**height <= most:
        height += 1
    left, right = _levels(a, height, fan), _levels(b, height, fan)
    bad = None
    for x, y in zip(reversed(left), reversed(right), strict=True):
        x, y = x.select("file", "node", "hash"), y.select("file", "node", F.col("hash").alias("other"))
        if bad is not None:
            under = bad.select("file", F.col("node").alias("parent"))
            x, y = (z.withColumn("parent", F.floor(F.col("node") / fan)).join(under, ["file", "parent"], "left_semi").drop("parent") for z in (x, y))
        bad = checkpointed(x.join(y, ["file", "node"], "full").where(~F.col("hash").eqNullSafe(F.col("other"))).select("file", "node"))
    # Records under nodes that differ: a file's, at most. A null id is told from others by a flag.
    key = [F.col("id").isNull().alias("no"), F.coalesce("id", F.lit(0)).alias("key")]
    x, y = (z.withColumn("node", F.floor(F.col("ordinal") / fan)).join(bad, ["file", "node"], "left_semi").select("file", *key, "digest", "ordinal", "offset") for z in (a, b))
    same = ["file", "no", "key", "digest", "k"]
    x, y = (z.withColumn("k", F.row_number().over(Window.partitionBy("file", "no", "key", "digest").orderBy("ordinal"))) for z in (x, y))
    met = checkpointed(x.join(y.withColumnsRenamed({"ordinal": "there", "offset": "at"}), same, "full"))
    moved = met.where("ordinal is not null and there is not null and (ordinal != there or offset != at)").select("file", "ordinal", "no", "key", F.lit("moved").alias("status"))
    here, there = met.where("there is null").select("file", "no", "key", "ordinal"), met.where("ordinal is null").select("file", "no", "key", "there")
    here, there = (z.withColumn("k", F.row_number().over(Window.partitionBy("file", "no", "key").orderBy(z.columns[-1]))) for z in (here, there))
    status = F.when(F.col("there").isNull(), "missing").when(F.col("ordinal").isNull(), "extra").otherwise("changed")
    rest = here.join(there, ["file", "no", "key", "k"], "full").select("file", F.coalesce("ordinal", "there").alias("ordinal"), "no", "key", status.alias("status"))
    return moved.union(rest).select("file", "ordinal", F.when(~F.col("no"), F.col("key")).alias("id"), "status")


def fixity(a: DataFrame, b: DataFrame, fan: int = FAN) -> DataFrame:
    """Every record of replica a with its status: `ok` where audit() finds nothing."""
    found = audit(a, b, fan).where("status != 'extra'").select("file", "ordinal", "status")
    return a.join(found, ["file", "ordinal"], "left").withColumn("status", F.coalesce("status", F.lit("ok")))
