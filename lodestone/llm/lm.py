"""Cross-entropy difference: two matched n-gram models with one vocabulary score every document.

Both are bigram models over the words of whole texts, each text between a begin and an end mark, with the same smoothing:
a bigram's count is backed by MU pseudo-counts of the word's unigram probability, which is add-one over the vocabulary, so
that the probabilities of the vocabulary, the unknown word and the end mark sum to 1 after every context. The vocabulary is
the words found MIN_COUNT times or more in all rows; the others are one unknown word, in contexts too. The target model
counts the target rows and the background model all others; its counts are scaled to the target's number of tokens, so
that the two are matched in weight and no row is left out. A document is scored without its own counts.

Counts of all documents are gathered by shuffles of hashed n-grams, words first and then bigrams: a chunk sends its
distinct ones with their counts, a bucket adds them up and sends the sums back, and the chunk scores its documents with
them, so nothing but a few totals reaches the driver. Texts are split once, and kept as numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import answered, answers_of, back, buckets, met, pack, places_of, sent_array, unpack

MIN_COUNT, MU = 2, 2.0
CHUNK, BUCKET_BYTES = 4 << 20, 4 << 20
#: Numbers of the begin mark, the end mark and the unknown word in a chunk, and what stands for their hashes.
BEGIN, END, UNKNOWN = 0, 1, 2
MARKS = (0x1234567, 0x7654321, 0x2BADBAD)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    return h * np.uint64(0xC2B2AE3D27D4EB4F)


def by_bucket(keys: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """(bucket, places of its keys, in an order that only the keys decide) for every bucket that has one."""
    order = np.argsort(keys, kind="stable")
    bucket = ((keys[order] >> np.uint64(20)) % np.uint64(n)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    found, starts = np.unique(bucket[by], return_index=True)
    return list(zip(found.tolist(), np.split(order[by], starts[1:]), strict=True)) if len(keys) else []


def planes(x: np.ndarray) -> bytes:
    """Numbers as 64 bits by byte, the lowest first: what is zero in all of them compresses to nothing."""
    return np.ascontiguousarray(x).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def steps(keys: np.ndarray) -> bytes:
    """Sorted keys, as the steps between them."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unsteps(raw: bytes) -> np.ndarray:
    return np.cumsum(unplanes(raw), dtype=np.uint64)


def sent(keys: np.ndarray, counts: np.ndarray, n: int) -> pa.Array:
    """Keys and their counts (a row for each model), by bucket."""
    import zstandard

    zip_ = zstandard.ZstdCompressor(level=1)
    return sent_array([(b, zip_.compress(steps(keys[at]) + planes(counts[:, at].ravel()))) for b, at in by_bucket(keys, n)], n)


def sums_of(got: list[dict], keys: np.ndarray, n: int) -> np.ndarray:
    """The buckets' answers → sums of the keys, a row for each model."""
    import zstandard

    unzip, blobs, out = zstandard.ZstdDecompressor(), {x["bucket"]: x["blob"] for x in got}, np.zeros((2, len(keys)), np.int64)
    for b, at in by_bucket(keys, n):
        out[:, at] = unplanes(unzip.decompress(blobs[b])).astype(np.int64).reshape(2, -1)
    return out


class Tokens:
    """The texts of a chunk as numbers of its distinct words, the marks and the unknown word being the first numbers."""

    def __init__(self, token: np.ndarray, lens: np.ndarray, target: np.ndarray, keys: np.ndarray) -> None:
        self.token, self.lens, self.target, self.keys = token, lens, target, keys  # of every text its words and the end mark
        self.row = np.repeat(np.arange(len(lens)), lens)
        self.weight = target[self.row]
        self.ends = np.cumsum(lens)

    def counts(self) -> np.ndarray:
        """Of words by number, the begin mark counted as a context: in all rows, in target rows."""
        out = np.stack([np.bincount(self.token, w, len(self.keys)) for w in (None, self.weight)]).astype(np.int64)
        out[:, BEGIN] = len(self.lens), self.target.sum()
        return out

    def bigrams(self, known: np.ndarray) -> None:
        """Numbers of the tokens and of what stands before them, with unknown words as one, and the distinct pairs."""
        number = np.where(known, np.arange(len(self.keys)), UNKNOWN)
        self.now = number[self.token]
        self.before = np.concatenate(([BEGIN], self.now[:-1])) if len(self.now) else self.now
        self.before[self.ends[:-1]] = BEGIN
        self.pairs, self.pair = np.unique(self.before * len(self.keys) + self.now, return_inverse=True)
        with np.errstate(over="ignore"):
            self.pair_keys = mix(self.keys[self.pairs // len(self.keys)] * np.uint64(3) + mix(self.keys[self.pairs % len(self.keys)]))

    def pair_counts(self) -> np.ndarray:
        return np.stack([np.bincount(self.pair, w, len(self.pairs)) for w in (None, self.weight)]).astype(np.int64)

    def own(self, numbers: np.ndarray) -> np.ndarray:
        """How often the number at each place stands in its own row."""
        _, at, n = np.unique(self.row * (int(numbers.max(initial=0)) + 1) + numbers, return_inverse=True, return_counts=True)
        return n[at]


def losses(t: Tokens, one: np.ndarray, two: np.ndarray, size: int, tokens: int, scale: float, mine: np.ndarray, mu: float) -> np.ndarray:
    """-log of the probability of every token, without its own row's counts where the row is the model's (mine).

    one, two: the model's sums by word (unknown: of all that are) and by pair; size: words of the vocabulary, the end mark
    and the unknown word; tokens: the model's, end marks included.
    """
    left = mine[t.row]
    word = one[t.now] - left * t.own(t.now)
    single = (scale * word + 1) / (scale * (tokens - left * t.lens[t.row]) + size)
    pair = two[t.pair] - left * t.own(t.pair)
    # A row has its begin mark once; any other word stands before another as often as it is found.
    context = one[t.before] - left * np.where(t.before == BEGIN, 1, t.own(t.before))
    return -np.log((scale * pair + mu * single) / (scale * context + mu))


def score(df: DataFrame, target: Column, text_col: str = "text", min_count: int = MIN_COUNT, mu: float = MU) -> DataFrame:
    """df without text_col, and: n_tokens (words and the end mark), h_target, h_background (nats for each of them under the
    model of the rows where `target` is true, and under that of the others, both without the row's own counts) and score,
    the difference: lower is more like the target. All three are null for a text without words (null, empty or blank),
    which counts in the models as an empty sequence. A null `target` is false. A model without rows is uniform over the
    vocabulary, and then counts are not scaled. Every row comes out once; columns with clashing names are replaced.
    """
    spark = df.sparkSession
    others = [c for c in df.columns if c != text_col]
    flagged = df.select(*[F.col(f"`{c}`").alias(f"d{i}") for i, c in enumerate(others)], F.coalesce(target, F.lit(False)).alias("target"), F.col(f"`{text_col}`").alias("text"))
    total = df.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")).cast("bigint"))).first()[0] or 0
    n, places = buckets(spark, total, BUCKET_BYTES), places_of(spark, total)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n)
    place = len(others)

    def split(texts: list[bytes | None], rows: pa.StructArray) -> dict[str, pa.Array]:
        import xxhash
        import zstandard

        number: dict[bytes, int] = {}
        words = [[number.setdefault(w, len(number)) for w in (t or b"").split()] for t in texts]
        flags = np.array(rows.field(place).to_pylist(), bool)
        with np.errstate(over="ignore"):
            keys = mix(np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number)))
        order = np.argsort(keys, kind="stable")  # words are numbered by their keys, behind the marks
        new = np.empty(len(order) + 1, np.int64)
        new[order], new[-1] = np.arange(len(order)) + len(MARKS), END
        token = new[np.array([x for w in words for x in (*w, -1)], np.int64)]
        z = zstandard.ZstdCompressor(level=1).compress
        cells = {"token": z(planes(token)), "lens": z(planes(np.array([len(w) + 1 for w in words]))), "flags": flags.tobytes(), "keys": z(steps(keys[order]))}
        return {k: pa.array([v], pa.binary()) for k, v in cells.items()}

    def chunk_of(batch: pa.RecordBatch, row: int) -> tuple[Tokens, dict]:
        import zstandard

        cells = {c: batch.column(i)[row].as_py() for i, c in enumerate(batch.schema.names) if c != "rows"}
        unzip = zstandard.ZstdDecompressor().decompress
        with np.errstate(over="ignore"):
            keys = np.concatenate((mix(np.array(MARKS, np.uint64)), unsteps(unzip(cells["keys"]))))
        return Tokens(unplanes(unzip(cells["token"])).astype(np.int64), unplanes(unzip(cells["lens"])).astype(np.int64), np.frombuffer(cells["flags"], bool), keys), cells

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                t, _ = chunk_of(batch, row)
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("chunk")).slice(row, 1), sent(t.keys, t.counts(), n)], names=["chunk", "sent"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip, zip_ = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        with np.errstate(over="ignore"):
            marks = mix(np.array(MARKS, np.uint64))
        for batch in batches:
            for row in range(batch.num_rows):
                got = batch.column(1)[row].as_py()
                raw = [unzip.decompress(x["blob"]) for x in got]
                sizes = [len(x) // 24 for x in raw]
                all_keys, at = np.unique(np.concatenate([unsteps(x[: 8 * k]) for x, k in zip(raw, sizes, strict=True)]), return_inverse=True)
                counts = np.concatenate([unplanes(x[8 * k :]).reshape(2, -1) for x, k in zip(raw, sizes, strict=True)], axis=1)
                sums = np.stack([np.bincount(at, c, len(all_keys)).astype(np.int64) for c in counts])
                ends = np.cumsum(sizes)
                out = [zip_.compress(planes(sums[:, at[b - k : b]].ravel())) for b, k in zip(ends.tolist(), sizes, strict=True)]
                # Totals, of use in the pass over words: known words, their tokens, those of rare ones, begin marks.
                mark = np.isin(all_keys, marks)
                known, rare = ~mark & (sums[0] >= min_count), ~mark & (sums[0] < min_count)
                facts = [int(known.sum())] + [int(x) for m in (known, rare, all_keys == marks[BEGIN]) for x in sums[:, m].sum(axis=1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([[x["chunk"] for x in got]], pa.list_(pa.int64())), pa.array([out], pa.list_(pa.binary())), pa.array([facts], pa.list_(pa.int64()))], names=["bucket", "chunks", "answers", "facts"])

    def summed(asked: DataFrame, name: str) -> DataFrame:
        out = met(asked, n, count, tasks).mapInArrow(add, "bucket int, chunks array<bigint>, answers array<binary>, facts array<bigint>")
        return answered(out, n, count, name, extra=("facts",))

    cols = ("token", "lens", "flags", "keys")
    sent_type = f"chunk bigint, sent {common.SENT}"
    chunks = pack(flagged, "text", CHUNK, places, (split, ", ".join(f"{c} binary" for c in cols)))
    count = chunks.count()
    ones = summed(chunks.select("chunk", *cols).mapInArrow(ask_words, sent_type), "words")
    facts = [int(x or 0) for x in ones.where("facts is not null").agg(*[F.sum(F.col("facts")[i]) for i in range(7)]).first()]
    rare = np.array(facts[3:5])
    # In all rows, in target rows: tokens, end marks included, of which each row has one.
    tokens = np.array(facts[1:3]) + rare + np.array(facts[5:7])
    size = facts[0] + 2
    scale = tokens[1] / (tokens[0] - tokens[1]) if 0 < tokens[1] < tokens[0] else 1.0
    # Chunks stay where they lie; only answers are shuffled to them.
    whole = answers_of(chunks, back(ones, n, tasks, places)).withColumnRenamed("got", "words")

    def with_words(batch: pa.RecordBatch, row: int) -> tuple[Tokens, np.ndarray, dict]:
        t, cells = chunk_of(batch, row)
        one = sums_of(cells["words"] or [], t.keys, n)
        known = one[0] >= min_count
        known[[BEGIN, END, UNKNOWN]] = True
        one[:, UNKNOWN] = rare
        t.bigrams(known)
        return t, one, cells

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                t, _, _ = with_words(batch, row)
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("chunk")).slice(row, 1), sent(t.pair_keys, t.pair_counts(), n)], names=["chunk", "sent"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                t, one, cells = with_words(batch, row)
                two = sums_of(cells["pairs"] or [], t.pair_keys, n)
                loss = []
                for j, s in ((1, 1.0), (0, scale)):
                    sums = (one[1], two[1], tokens[1]) if j else (one[0] - one[1], two[0] - two[1], tokens[0] - tokens[1])
                    per = np.concatenate(([0.0], np.cumsum(losses(t, sums[0], sums[1], size, int(sums[2]), s, t.target == bool(j), mu))))
                    loss.append((per[t.ends] - per[t.ends - t.lens]) / t.lens)
                empty = t.lens == 1
                made = [pa.array([t.lens.tolist()], pa.list_(pa.int64()))]
                made += [pa.array([[None if x else float(v) for v, x in zip(col, empty, strict=True)]], pa.list_(pa.float64())) for col in (loss[0], loss[1], loss[0] - loss[1])]
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("rows")).slice(row, 1), *made], names=["rows", "n", "t", "b", "s"])

    twos = summed(whole.select("chunk", *cols, "words").mapInArrow(ask, sent_type), "pairs")
    out = answers_of(whole, back(twos, n, tasks, places)).select("rows", *cols, "words", F.col("got").alias("pairs"))
    out = out.mapInArrow(join, f"rows {chunks.schema['rows'].dataType.simpleString()}, n array<bigint>, t array<double>, b array<double>, s array<double>")
    return unpack(out, others, {"n_tokens": "n", "h_target": "t", "h_background": "b", "score": "s"})

