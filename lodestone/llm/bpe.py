"""Byte-level BPE: each distinct pre-token of the corpus is encoded once, in a global shuffle of distinct words.

Texts are packed into chunks. A chunk splits its texts into pre-tokens once, keeps their numbers in order of position, and
sends its distinct ones, by hash, to buckets; a bucket encodes each word that it got from any chunk once and sends the ids
back; the chunk puts them together by position. Decoding joins the ids with the table of token bytes.
"""

from __future__ import annotations

import base64
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import answered, answers_of, back, buckets, met, pack, places_of, sent_array, ship, unpack

#: Bytes of text in a chunk, and for each bucket.
CHUNK, BUCKET_BYTES = 5 << 20, 8 << 20


def ranks_of(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its id on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def buckets_of(words: list[str], n: int) -> np.ndarray:
    """The bucket of every word."""
    from xxhash import xxh32_intdigest

    return np.fromiter(map(xxh32_intdigest, words), np.int64, len(words)) % n


def by_bucket(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(bucket, numbers of its words in order) for every bucket that has one."""
    order = np.argsort(bucket, kind="stable")
    found, starts = np.unique(bucket[order], return_index=True)
    return list(zip(found.tolist(), np.split(order, starts[1:]), strict=True)) if len(bucket) else []


#: Texts on whose every pair, joined by a space, a pattern is tried for a lone space that always begins a match.
PROBES = ("", "a", "Zz", "é", "漢", "5", "'", "'s", "!", "...", "_", "a!", "7s", "\n", "\t", "x\n", "\u00a0", "\u3000")


class Pretokens:
    """Splits texts as the library that encodes them would.

    Where a lone space between two other characters always begins a match, a text is cut at single spaces first, and only
    its distinct units are matched against the pattern. A unit that is empty or begins with white space, but for the first,
    may be part of a longer run: then the whole text is matched, as it always is under other patterns. Libraries know
    different versions of Unicode: a text with a code point that has no meaning yet here is a single pre-token, and left
    to the library.
    """

    def __init__(self, pattern: str) -> None:
        import regex

        self.find = find = regex.compile(pattern).findall
        self.cut = all(find(f"{a} {b}") == find(a) + find(f" {b}") for a in PROBES for b in PROBES if b and not b[0].isspace())
        self.ids: dict[str, int] = {}  # pre-token: number
        self.units: dict[str, int] = {}  # unit: number
        self.parts: list[list[int] | None] = []  # of a unit: numbers of its pre-tokens; None: not safe to cut here

    def _whole(self, text: str, found: list[str], mark: str) -> list[int]:
        """The text as a unit of its own; with the mark no unit of a cut text is equal to it."""
        j = self.units.setdefault(mark + text, len(self.units))
        if j == len(self.parts):
            self.parts.append([self.ids.setdefault(x, len(self.ids)) for x in found])
        return [j]

    def number(self, texts: list[str]) -> list[list[int]]:
        units, rows = self.units, []
        if not self.cut:
            return [self._whole(t, self.find(t), " \0") if t else [] for t in texts]
        for text in texts:
            cut = text.split(" ")
            cut[1:] = [" " + u for u in cut[1:]]
            rows.append([units.setdefault(u, len(units)) for u in cut] if text else [])
        added = list(units)[len(self.parts) :]
        ids, find = self.ids, self.find
        for u in added:
            if u[:1] == " " and (len(u) == 1 or u[1].isspace()):
                self.parts.append(None)
            else:
                self.parts.append([ids.setdefault(x, len(ids)) for x in find(u)])
        unsafe = {i for i in range(len(self.parts)) if self.parts[i] is None}
        unknown = "".join(c for c in set().union(*map(set, texts)) if c > "\x7f" and unicodedata.category(c) == "Cn")
        for i, (text, row) in enumerate(zip(texts, rows, strict=True)) if unsafe or unknown else ():
            if unknown and not set(unknown).isdisjoint(text):
                rows[i] = self._whole(text, [text], " \1")
            elif not unsafe.isdisjoint(row):
                rows[i] = self._whole(text, find(text), " \0")
        return rows


def gather(values: np.ndarray, starts: np.ndarray, lens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """values holds lists, of which starts and lens give the places → the lists numbered `at`, joined."""
    starts, lens = starts[at], lens[at]
    total = int(lens.sum())
    return values[np.arange(total) + np.repeat(starts - (np.cumsum(lens) - lens), lens)] if total else values[:0]


def planes(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, their lowest bytes first, then the next: what is zero in all of them compresses to nothing."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def numbered(units: np.ndarray, parts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """units: numbers of units; parts: numbers of pre-tokens, `sizes` of them for each unit → (units, parts, sizes, words), in which
    frequent units have small numbers, as these compress best: units as numbers from 1, those that are there more than once
    first, the most frequent at 1; a unit that is there once is 0 (the next of those, whose parts come last). parts as numbers
    from 1, in order of their first place, where it is 0. words: the pre-tokens in this order."""
    found = np.bincount(units, minlength=len(sizes))
    often = np.flatnonzero(found > 1)
    often = often[np.argsort(-found[often], kind="stable")]
    rank = np.zeros(len(sizes), np.int64)
    rank[often] = np.arange(1, len(often) + 1)
    order = np.concatenate((often, units[found[units] == 1]))
    parts = gather(parts, np.cumsum(sizes) - sizes, sizes, order)
    words, first, parts = np.unique(parts, return_index=True, return_inverse=True)
    by_place = np.argsort(first, kind="stable")
    number = np.empty(len(words), np.int64)
    number[by_place] = np.arange(1, len(words) + 1)
    parts = number[parts]
    parts[first] = 0
    return rank[units], parts, sizes[order], words[by_place]


def plain_numbers(units: np.ndarray, parts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """units and parts of numbered() → the same as places in sizes and in words."""
    once, new = units == 0, parts == 0
    return np.where(once, len(sizes) - once.sum() + np.cumsum(once), units) - 1, np.where(new, np.cumsum(new), parts) - 1


#: What stands between words: a byte that no text has.
BETWEEN = b"\xff"


def _pack_words(words: list[str]) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(BETWEEN.join(w.encode("utf-8", "surrogatepass") for w in words))


def _unpack_words(blob: bytes) -> list[str]:
    import zstandard

    return [w.decode("utf-8", "surrogatepass") for w in zstandard.ZstdDecompressor().decompress(blob).split(BETWEEN)]


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", decode: bool = True) -> DataFrame:
    """df without text_col, and: n_tokens, ids (binary: little-endian unsigned 32-bit), and, if decode, decoded (binary: the
    bytes of the ids' tokens). Special tokens' strings are ordinary text. Null and empty texts have no ids; bytes that are no
    UTF-8 are U+FFFD, as the library takes strings only. Every row comes out once, repeated ones included; columns with
    clashing names are replaced.
    """
    spark = df.sparkSession
    # Measured, not estimated: Spark takes a size it doesn't know for the largest there is.
    total = df.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")).cast("bigint"))).first()[0] or 0
    places, n = places_of(spark, total), buckets(spark, total, BUCKET_BYTES)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n)
    table = spark.sparkContext.broadcast((ranks, pattern))  # the vocabulary: a fixed size, whatever the corpus
    stored = ("units", "lens", "parts", "sizes", "asked")

    def split(texts: list[bytes | None], _: pa.StructArray) -> dict[str, pa.Array]:
        """Units of every text in order, pre-tokens of every unit, and what is sent: the distinct pre-tokens by bucket."""
        import zstandard

        pre = Pretokens(table.value[1])
        rows = pre.number(["" if t is None else t.decode("utf-8", "replace") for t in texts])
        words, parts = list(pre.ids), [p or [] for p in pre.parts]
        del pre
        array_ = lambda lists: np.array([x for r in lists for x in r], np.int64)
        sizes = np.array(list(map(len, parts)), np.int64)
        units, parts, sizes, own = numbered(array_(rows), array_(parts), sizes)
        words = [words[i] for i in own.tolist()]
        at_bucket = buckets_of(words, n)
        sent = [(b, _pack_words([words[i] for i in at.tolist()])) for b, at in by_bucket(at_bucket)]
        numbers = {"units": units, "lens": np.array(list(map(len, rows)), np.int64), "parts": parts, "sizes": sizes, "asked": at_bucket}
        zip_ = zstandard.ZstdCompressor(level=1)
        return {k: pa.array([zip_.compress(planes(v))], pa.binary()) for k, v in numbers.items()} | {"sent": sent_array(sent, n)}

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        import zstandard

        ranks, pattern = table.value
        tokens = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        zip_ = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for row in range(batch.num_rows):
                known: dict[str, bytes] = {}
                chunks, out = [], []
                for x in batch.column(1)[row]:
                    words = _unpack_words(x["blob"].as_py())
                    for w in words:
                        if w not in known:
                            one = ranks.get(w.encode()) if w.isascii() else None
                            known[w] = array("I", tokens.encode_ordinary(w) if one is None else (one,)).tobytes()
                    ids = [known[w] for w in words]
                    lens = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                    chunks.append(x["chunk"].as_py())
                    out.append(zip_.compress(planes(np.concatenate((lens, np.frombuffer(b"".join(ids), "<u4"))))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([chunks], pa.list_(pa.int64())), pa.array([out], pa.list_(pa.binary()))], names=["bucket", "chunks", "answers"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        ranks = table.value[0]
        by_id = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, v in ranks.items():
            by_id[v] = k
        token_bytes = np.frombuffer(b"".join(by_id), np.uint8)
        token_lens = np.fromiter(map(len, by_id), np.int64, len(by_id))
        token_starts = np.cumsum(token_lens) - token_lens
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in range(batch.num_rows):
                cell = lambda name: batch.column(batch.schema.get_field_index(name))[row].as_py()  # noqa: B023, E731
                units, per_row, flat, sizes, asked = (unplanes(unzip.decompress(cell(c))).astype(np.int64) for c in stored)
                units, flat = plain_numbers(units, flat, sizes)
                lens, starts, blobs, held = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64), [], 0
                got = {x["bucket"]: x["blob"] for x in cell("got") or []}
                for b, at in by_bucket(asked):
                    numbers = unplanes(unzip.decompress(got[b]))
                    own = numbers[: len(at)].astype(np.int64)
                    lens[at] = own
                    starts[at] = held + np.cumsum(own) - own
                    blobs.append(numbers[len(at) :])
                    held += int(own.sum())
                # The ids of a unit: those of its pre-tokens, which stand one after the other.
                unit_ids = gather(np.concatenate([*blobs, np.zeros(0, "<u4")]), starts, lens, flat)
                ends = np.concatenate(([0], np.cumsum(lens[flat])))[np.concatenate(([0], np.cumsum(sizes)))]
                unit_starts, unit_lens = ends[:-1], np.diff(ends)
                made, decoded = [], []
                for r in np.split(units, np.cumsum(per_row)[:-1]):
                    x = gather(unit_ids, unit_starts, unit_lens, r)
                    made.append(x.astype("<u4").tobytes())
                    decoded.append(gather(token_bytes, token_starts, token_lens, x.astype(np.int64)).tobytes() if decode else None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([made], pa.list_(pa.binary())), pa.array([decoded], pa.list_(pa.binary()))], names=["rows", "ids", "decoded"])

    chunks = pack(df, text_col, CHUNK, places, (split, ", ".join(f"{c} binary" for c in stored) + f", sent {common.SENT}"))
    count = chunks.count()
    asked = met(chunks.select("chunk", "sent"), n, count, tasks).mapInArrow(answer, "bucket int, chunks array<bigint>, answers array<binary>")
    ids = answered(asked, n, count, "ids")
    whole = answers_of(chunks.drop("sent"), back(ids, n, tasks, places)).select("rows", *stored, "got")
    out = whole.mapInArrow(join, f"rows {chunks.schema['rows'].dataType.simpleString()}, ids array<binary>, decoded array<binary>")
    out = unpack(out, [c for c in df.columns if c != text_col], {"ids": "ids", "decoded": "decoded"})
    keep = [F.col(f"`{c}`") for c in out.columns if c not in ("ids", "decoded", "n_tokens")]
    return out.select(*keep, (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", *(["decoded"] if decode else []))


def decode(df: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids") -> DataFrame:
    """df and decoded: the bytes of ids_col (binary: little-endian unsigned 32-bit ids), null where it is null. An id
    without a token raises IndexError."""
    ship(df.sparkSession)
    size = max(ranks.values(), default=-1) + 1
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        by_id: list[bytes | None] = [None] * size
        for k, v in shared.value.items():
            by_id[v] = k
        for b in batches:
            out = []
            for x in b.column(b.schema.get_field_index(ids_col)).to_pylist():
                found = None if x is None else [by_id[i] for i in np.frombuffer(x, "<u4").tolist()]
                if found is not None and None in found:
                    raise IndexError("an id without a token")
                out.append(None if found is None else b"".join(found))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.drop("decoded").schema.fields)
    return df.drop("decoded").mapInArrow(run, schema + ", decoded binary")
