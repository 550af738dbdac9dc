"""Phrases of words that stand together more often than chance has it, found by growing frequent prefixes.

Words are counted in the whole corpus, by language: a chunk of documents sends its distinct words to buckets and gets back the
numbers of frequent ones. Then pairs of them are counted: a chunk sends its distinct pairs and gets a bit back for each. Then it projects the corpus: each occurrence of a
frequent pair that another one follows becomes a pointer, which carries the words right of it as far as they are frequent
pairs (five words at most). Equal ones are counted once, and pointers go to the task of their prefix. A task extends its
prefixes to the right, depth first: pointers are sorted by their next word, each run that is frequent is a phrase, and its
pointers are extended in turn.

A prefix belongs to one task, and no task has more than HOT pointers of one prefix: a pointer's prefix is its first word, or as
many words as it takes until one of them is found at most HOT times. Counts of phrases that are shorter than that are partial
in each task and are added up afterwards. Where all five words are hotter, pointers that meet are equal: one count for each chunk.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import answered, answers_of, back, buckets, met, pack, places_of, removed, sent_array, written
from .lm import planes, unplanes

#: Occurrences that make a phrase frequent, words of the longest, phrases of a language that are returned.
LEAST, LONGEST, MOST = 100, 5, 2000
#: Pointers of one prefix in a task at most; bytes of text for each task.
HOT, BUCKET_BYTES, CHUNK = 500_000, 8 << 20, 4 << 20
#: What ends a piece, and the lower case of A-Z.
ENDS = b".,;:!?\n\x0b\x0c\r"
#: What a bucket says of its words: the frequent ones, and how often those of a language are found.
FREQUENT = pa.list_(pa.struct([("lang", pa.string()), ("word", pa.binary()), ("id", pa.int64()), ("f", pa.int64())]))
SUMS = pa.list_(pa.struct([("lang", pa.string()), ("n", pa.int64())]))
LOWER = bytes.maketrans(bytes(range(65, 91)) + ENDS + b"\t", bytes(range(97, 123)) + b"\n" * len(ENDS) + b" ")


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, most: int = MOST, hot: int = HOT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) by language (null: und), as scored() and ranked() state. A null text is empty;
    every row counts, repeated ones too; other columns don't matter."""
    words, totals, found = phrases(df, text_col, lang_col, least, longest, hot)
    return ranked(scored(words, totals, found), words, most)


def phrases(df: DataFrame, text_col: str, lang_col: str, least: int, longest: int, hot: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent words (lang, word, id, f), words in all (lang, n), and phrases of 2 to `longest` words that are found `least`
    times or more (ids: array of word ids, a)."""
    spark = df.sparkSession
    slim = df.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    size = slim.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    n = buckets(spark, size, BUCKET_BYTES)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n)
    places = places_of(spark, size)
    chunks = pack(slim, "text", CHUNK, places, (lambda texts, rows: _tokens(texts, rows, n), f"tokens binary, asked binary, sent {common.SENT}"))
    count = chunks.count()

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                got = batch.column(1)[row].as_py()
                answers, frequent, sums = _tallied([x["blob"] for x in got], batch.column(0)[row].as_py(), n, least, hot)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([[x["chunk"] for x in got]], pa.list_(pa.int64())), pa.array([answers], pa.list_(pa.binary())), pa.array([frequent], FREQUENT), pa.array([sums], SUMS)], names=["bucket", "chunks", "answers", "frequent", "sums"])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                coded = _coded(*(batch.column(i)[row].as_py() for i in (2, 3, 4)), n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), batch.column(1).slice(row, 1), pa.array([coded], pa.binary())], names=["chunk", "part", "words"])

    # Each word that a chunk asks for gets an answer, frequent or not, so answers grow with the text.
    tallied = met(chunks.select("chunk", "sent"), n, count, tasks).mapInArrow(tally, "bucket int, chunks array<bigint>, answers array<binary>, frequent array<struct<lang:string, word:binary, id:bigint, f:bigint>>, sums array<struct<lang:string, n:bigint>>")
    ones = answered(tallied, n, count, "words", extra=("frequent", "sums"))
    words = written(ones.where("frequent is not null").select(F.explode("frequent").alias("x")).select("x.*"), "frequent")
    totals = ones.where("sums is not null").select(F.explode("sums").alias("x")).groupBy("x.lang").agg(F.sum("x.n").alias("n"))
    coded = answers_of(chunks.select("chunk", "part", "tokens", "asked"), back(ones, n, tasks, places)).select("chunk", "part", "tokens", "asked", "got")
    coded = written(coded.mapInArrow(code, "chunk bigint, part int, words binary"), "coded", (places, "part"))
    removed(chunks)  # its words have their ids, and all that is made of it is written

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), sent_array(Pairs(batch.column(1)[row].as_py(), n).sent(), n)], names=["chunk", "sent"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                got = batch.column(1)[row].as_py()
                answers, ids, fs = _frequent_pairs([x["blob"] for x in got], least)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([[x["chunk"] for x in got]], pa.list_(pa.int64())), pa.array([answers], pa.list_(pa.binary())), pa.array([ids], pa.list_(pa.list_(pa.int64()))), pa.array([fs], pa.list_(pa.int64()))], names=["bucket", "chunks", "answers", "ids", "fs"])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                pairs = Pairs(batch.column(1)[row].as_py(), n)
                found = _projected(pairs, pairs.frequent(batch.column(2)[row].as_py() or []), longest, n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), sent_array(found, n)], names=["chunk", "sent"])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield from _grown([x["blob"].as_py() for x in batch.column(0)[row]], longest, least)

    sent_type = f"chunk bigint, sent {common.SENT}"
    asked = met(coded.select("chunk", "words").mapInArrow(ask, sent_type), n, count, tasks)
    asked = asked.mapInArrow(add, "bucket int, chunks array<bigint>, answers array<binary>, ids array<array<bigint>>, fs array<bigint>")
    twos = answered(asked, n, count, "pairs", extra=("ids", "fs"))
    pairs = twos.where("ids is not null").select(F.explode(F.arrays_zip("ids", "fs")).alias("x")).select("x.ids", F.col("x.fs").alias("a"))
    pointers = answers_of(coded, back(twos, n, tasks, places)).select("chunk", "words", "got").mapInArrow(project, sent_type)
    got = met(pointers, n, count, tasks).select("met").mapInArrow(grow, "ids array<bigint>, a bigint")
    longer = got.groupBy("ids").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return words, totals, written(pairs.unionByName(longer) if longest > 2 else pairs, "phrases")


def _tokens(texts: list[bytes | None], rows: pa.StructArray, n: int) -> dict[str, pa.Array]:
    """A chunk's texts as numbers of its distinct words, by language, with -1 between pieces; the bucket of each word; and what is
    sent to the buckets."""
    import zstandard
    from xxhash import xxh32_intdigest

    langs = rows.field(0).to_pylist()
    names = sorted(set(langs))
    zip_ = zstandard.ZstdCompressor(level=1)
    out, kinds, words, counts, asked = [np.zeros(0, np.int64)], [], [], [], [np.zeros(0, np.int64)]
    for i, lang in enumerate(names):
        known = {b"\n": -1}
        joined = b"\n".join(t for t, x in zip(texts, langs, strict=True) if x == lang and t)
        split = joined.translate(LOWER).replace(b"\n", b" \n ").split(b" ")
        place = known.setdefault
        ids = np.fromiter((place(w, len(known)) for w in split if w), np.int64)
        out += [np.where(ids > 0, ids - 1 + len(words), -1), np.array([-1])]
        own, seed = list(known)[1:], zlib.crc32(lang.encode())
        counts.append(np.bincount(ids[ids >= 0], minlength=len(known))[1:])
        asked.append(np.fromiter((xxh32_intdigest(w, seed) for w in own), np.int64, len(own)) % n)
        kinds.append(np.full(len(own), i))
        words += own
    bucket, counts, kinds = np.concatenate(asked), np.concatenate([*counts, np.zeros(0, np.int64)]), np.concatenate([*kinds, np.zeros(0, np.int64)])
    sent = []
    for b, at in _by(bucket):
        of, k = np.unique(kinds[at], return_counts=True)
        head = json.dumps([[names[i], m] for i, m in zip(of.tolist(), k.tolist(), strict=True)]).encode()
        sent.append((b, zip_.compress(b"\n".join((head, *(words[i] for i in at.tolist()), planes(counts[at]))))))
    # Between pieces 1, a word's first place 0, as words are numbered in the order of these: what is frequent compresses best.
    tokens = np.concatenate(out)
    new = tokens > np.maximum.accumulate(np.concatenate(([-1], tokens)))[:-1]
    cell = lambda v: pa.array([zip_.compress(planes(v))], pa.binary())
    return {"tokens": cell(np.where(new, 0, tokens + 2)), "asked": cell(bucket), "sent": sent_array(sent, n)}


def _tallied(blobs: list[bytes], bucket: int, n: int, least: int, hot: int) -> tuple[list[bytes], list[dict], list[dict]]:
    """What chunks sent to a bucket → for each chunk's words twice the place, from 1, of a word among the bucket's frequent ones, and
    one more if it is hot, 0 for others; the frequent words with their ids, which are of the bucket alone; all words by language."""
    import zstandard

    zip_, unzip = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    known: dict[str, dict[bytes, int]] = {}
    asked: list[list[tuple[str, np.ndarray, np.ndarray]]] = []
    for blob in blobs:
        head, rest = unzip.decompress(blob).split(b"\n", 1)
        langs, own = json.loads(head), []
        *words, counts = rest.split(b"\n", sum(k for _, k in langs))
        counts, at = unplanes(counts).astype(np.int64), 0
        for lang, k in langs:
            place = known.setdefault(lang, {})
            own.append((lang, np.fromiter((place.setdefault(w, len(place)) for w in words[at : at + k]), np.int64, k), counts[at : at + k]))
            at += k
        asked.append(own)
    sums = {lang: np.zeros(len(place), np.int64) for lang, place in known.items()}
    for own in asked:
        for lang, at, counts in own:
            sums[lang][at] += counts  # a chunk has a word once
    frequent, code, before = [], {}, 0
    for lang, f in sums.items():
        some = f >= least
        place = np.cumsum(some) + before
        code[lang] = np.where(some, 2 * place + (f > hot), 0)
        before += int(some.sum())
        names = list(known[lang])
        frequent += [{"lang": lang, "word": names[i], "id": int(place[i] - 1) * n + bucket + 1, "f": int(f[i])} for i in np.flatnonzero(some).tolist()]
    answers = [zip_.compress(planes(np.concatenate([code[lang][at] for lang, at, _ in own]))) for own in asked]
    return answers, frequent, [{"lang": lang, "n": int(f.sum())} for lang, f in sums.items()]


def _coded(tokens: bytes, asked: bytes, got: list[dict] | None, n: int) -> bytes:
    """A chunk's words by their ids in the corpus, hot ones below zero, 0 where there is none: how many ids there are, these from the
    most frequent on, and of every word which of them it is."""
    import zstandard

    unzip = zstandard.ZstdDecompressor()
    t, bucket = (unplanes(unzip.decompress(x)).astype(np.int64) for x in (tokens, asked))
    t = np.where(t == 0, np.cumsum(t == 0) - 1, t - 2)
    number = np.zeros(len(bucket) + 1, np.int64)  # -1 is the last place
    blobs = {x["bucket"]: x["blob"] for x in got or []}
    for b, at in _by(bucket):
        code = unplanes(unzip.decompress(blobs[b])).astype(np.int64)
        number[at] = np.where(code > 0, ((code >> 1) - 1) * n + b + 1, 0) * np.where(code & 1, -1, 1)
    ids, at, found = np.unique(number[t], return_inverse=True, return_counts=True)
    order = np.argsort(-found, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    return zstandard.ZstdCompressor(level=1).compress(planes(np.concatenate(([len(ids)], ids[order], rank[at]))))


def _words(coded: bytes) -> np.ndarray:
    """The words of _coded(), one after the other."""
    import zstandard

    x = unplanes(zstandard.ZstdDecompressor().decompress(coded)).astype(np.int64)
    return x[1 : 1 + x[0]][x[1 + x[0] :]]


def _mixed(columns: list[np.ndarray], n: int) -> np.ndarray:
    """Buckets of rows of numbers."""
    key = np.zeros(len(columns[0]), np.uint64)
    with np.errstate(over="ignore"):
        for c in columns:
            key = (key ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
    return ((key >> np.uint64(11)) % np.uint64(n)).astype(np.int64)


def _by(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(bucket, its places)."""
    order = np.argsort(bucket, kind="stable")
    found, at = np.unique(bucket[order], return_index=True)
    return list(zip(found.tolist(), np.split(order, at[1:]), strict=True)) if len(bucket) else []


class Pairs:
    """The words of a chunk, where two frequent ones stand together, and the distinct pairs of these."""

    def __init__(self, words: bytes, n: int) -> None:
        word = _words(words)
        self.word, self.hot = np.abs(word), word < 0
        self.starts = np.flatnonzero((self.word[:-1] > 0) & (self.word[1:] > 0))
        own, local = np.unique(self.word, return_inverse=True)
        pair, self.pair, self.counts = np.unique(local[self.starts] * len(own) + local[self.starts + 1], return_inverse=True, return_counts=True)
        self.left, self.right = own[pair // len(own)], own[pair % len(own)]
        self.by = _by(_mixed([self.left, self.right], n)) if len(pair) else []

    def sent(self) -> list[tuple[int, bytes]]:
        import zstandard

        zip_ = zstandard.ZstdCompressor(level=1)
        return [(b, zip_.compress(b"".join(planes(x) for x in (np.diff(self.left[at], prepend=0), self.right[at], self.counts[at])))) for b, at in self.by]

    def frequent(self, got: list[dict]) -> np.ndarray:
        """Whether a frequent pair begins at each place, by the buckets' answers."""
        blobs = {x["bucket"]: x["blob"] for x in got}
        yes = np.zeros(len(self.left), bool)
        for b, at in self.by:
            yes[at] = np.unpackbits(np.frombuffer(blobs[b], np.uint8), count=len(at)).astype(bool)
        out = np.zeros(len(self.word), bool)
        out[self.starts] = yes[self.pair]
        return out


def _frequent_pairs(blobs: list[bytes], least: int) -> tuple[list[bytes], list[list[int]], list[int]]:
    """For each chunk's pairs a bit, whether they are frequent in all; the frequent pairs and their counts."""
    import zstandard

    unzip, cols = zstandard.ZstdDecompressor(), []
    for blob in blobs:
        raw = unzip.decompress(blob)
        left, right, counts = (unplanes(raw[i * len(raw) // 3 : (i + 1) * len(raw) // 3]).astype(np.int64) for i in range(3))
        cols.append((np.cumsum(left), right, counts))
    left, right, counts = (np.concatenate(x) for x in zip(*cols, strict=True))
    order = np.lexsort((right, left))
    a, b = left[order], right[order]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    sums = np.add.reduceat(counts[order], first)
    yes = np.zeros(len(left), bool)
    yes[order] = np.repeat(sums >= least, np.diff(np.append(first, len(order))))
    ends = np.cumsum([len(x[0]) for x in cols])
    some = sums >= least
    return [np.packbits(x).tobytes() for x in np.split(yes, ends[:-1])], np.stack((a[first][some], b[first][some]), axis=1).tolist(), sums[some].tolist()


def _projected(pairs: Pairs, frequent: np.ndarray, longest: int, n: int) -> list[tuple[int, bytes]]:
    """(bucket, pointers) of a chunk: distinct rows of three to `longest` ids, 0 behind the last, how often each is found, and how
    many of its words are its prefix. A row ends where its words are no frequent pair."""
    import zstandard

    zip_ = zstandard.ZstdCompressor(level=1)
    starts = np.flatnonzero(frequent[:-1] & frequent[1:])
    if not len(starts) or longest < 3:
        return []
    pad = lambda x: np.concatenate((x, np.zeros(longest, x.dtype)))
    word, hot, pair = pad(pairs.word), pad(pairs.hot), pad(frequent)
    goes = np.cumprod(np.stack([pair[starts + j] for j in range(longest - 1)], axis=1), axis=1)
    rows = np.stack([word[starts + j] for j in range(longest)], axis=1)
    rows[:, 1:] *= goes
    # The prefix: words up to the first that isn't hot, or all. Where a row ends before that, what ends it is part of the prefix.
    hots = np.stack([hot[starts + j] for j in range(longest)], axis=1) & (rows > 0)
    depth = np.minimum(np.cumprod(hots, axis=1).sum(axis=1) + 1, longest)
    order = np.lexsort(rows.T[::-1])
    rows, depth = rows[order], depth[order]
    new = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1))))
    counts, rows, depth = np.diff(np.append(new, len(rows))), rows[new], depth[new]
    kind = "<i4" if rows.max() < 1 << 31 else "<i8"
    out = []
    for b, where in _by(_mixed([np.where(depth > j, rows[:, j], 0) for j in range(longest)], n)):
        raw = rows[where]
        raw[:, 0] = np.diff(raw[:, 0], prepend=0)
        out.append((b, kind.encode() + zip_.compress(b"".join((depth[where].astype("<i1").tobytes(), counts[where].astype("<i4").tobytes(), _planes(raw.astype(kind)))))))
    return out


def _planes(rows: np.ndarray) -> bytes:
    """Column after column, byte by byte of a number."""
    return np.ascontiguousarray(rows.T).view(np.uint8).reshape(rows.shape[1], rows.shape[0], -1).transpose(0, 2, 1).tobytes()


def _pointers(blob: bytes, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    import zstandard

    kind, raw = blob[:3].decode(), zstandard.ZstdDecompressor().decompress(blob[3:])
    width = int(kind[2])
    m = len(raw) // (5 + width * longest)
    depth, counts = np.frombuffer(raw, "<i1", m).astype(np.int64), np.frombuffer(raw, "<i4", m, m).astype(np.int64)
    planes = np.frombuffer(raw, np.uint8, offset=5 * m).reshape(longest, width, m)
    rows = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind).reshape(longest, m).T.astype(np.int64)
    rows[:, 0] = np.cumsum(rows[:, 0])
    return rows, counts, depth


def _grown(blobs: list[bytes], longest: int, least: int) -> Iterator[pa.RecordBatch]:
    """Phrases of three words or more and their counts among the pointers of a task: all frequent ones under its prefixes, and of
    those that are shorter than their pointers' prefix whatever is there, as other tasks have more."""
    rows, counts, depth = (np.concatenate(x) for x in zip(*(_pointers(b, longest) for b in blobs), strict=True))
    out, sums, held = [], [], 0

    def extend(at: np.ndarray, done: int, prefix: list[int]) -> Iterator[pa.RecordBatch]:
        """at: the pointers that begin with prefix, of `done` words."""
        nonlocal held
        word = rows[at, done]
        at, word = at[word > 0], word[word > 0]
        if not len(at):
            return
        order = np.argsort(word, kind="stable")
        at, word = at[order], word[order]
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        sums_ = np.add.reduceat(counts[at], first)
        partial = np.maximum.reduceat(depth[at], first) > done + 1
        go = np.flatnonzero(partial | (sums_ >= least))
        ends = np.append(first[1:], len(at))
        for i in go.tolist():
            longer = [*prefix, int(word[first[i]])]
            if done > 1:
                out.append(longer)
                sums.append(int(sums_[i]))
                held += 1
            if done + 1 < longest:
                yield from extend(at[first[i] : ends[i]], done + 1, longer)
            if held >= 50_000:
                yield flush()

    def flush() -> pa.RecordBatch:
        nonlocal held
        made = pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64())), pa.array(sums, pa.int64())], names=["ids", "a"])
        out.clear()
        sums.clear()
        held = 0
        return made

    yield from extend(np.arange(len(rows)), 0, [])
    yield flush()


def scored(words: DataFrame, totals: DataFrame, found: DataFrame) -> DataFrame:
    """Phrases (ids, lang, a, l, r, n, score): the cut into two parts, found l and r times, of the least floor(1000 a n / (l r)),
    ties to the shortest first part. Products are exact decimals. A phrase goes that stands in a longer one found as often."""
    langs = words.select(F.array("id").alias("part"), "lang", F.col("f").alias("a"))
    # A part of two words or more is itself frequent, so it is among the phrases.
    counts = langs.select("part", "a").unionByName(found.select(F.col("ids").alias("part"), "a"))
    # It is enough to look at phrases that are longer by one word: those between are found no less often than the longest.
    longer = found.where(F.size("ids") > 2).select("a", F.explode(F.array(F.expr("slice(ids, 1, size(ids) - 1)"), F.expr("slice(ids, 2, size(ids) - 1)"))).alias("ids"))
    inside = longer.groupBy("ids").agg(F.max("a").alias("most"))
    kept = found.join(inside, "ids", "left").where(F.col("most").isNull() | (F.col("most") < F.col("a"))).select("ids", "a")
    cuts = kept.select("ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.select("ids", "a", "k", F.expr("slice(ids, 1, k)").alias("left_"), F.expr("slice(ids, k + 1, size(ids) - k)").alias("right_"))
    cuts = cuts.join(counts.select(F.col("part").alias("left_"), F.col("a").alias("l")), "left_").join(counts.select(F.col("part").alias("right_"), F.col("a").alias("r")), "right_")
    cuts = cuts.join(langs.select(F.col("part")[0].alias("id_"), "lang"), F.col("ids")[0] == F.col("id_")).join(totals, "lang")
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = cuts.withColumn("top", (exact("a") * exact("n")).cast("decimal(38,0)") * F.lit(1000).cast("decimal(4,0)")).withColumn("below", (exact("l") * exact("r")).cast("decimal(38,0)"))
    cuts = cuts.withColumn("score", F.expr("cast(top as decimal(38,0)) div below"))
    best = F.min(F.struct("score", "k", "l", "r")).alias("b")
    return cuts.groupBy("ids", "lang", "a", "n").agg(best).select("ids", "lang", "a", "b.l", "b.r", "n", "b.score")


def ranked(scored: DataFrame, words: DataFrame, most: int) -> DataFrame:
    """The first `most` of each language: by score and count, both falling, then by the phrase's bytes."""
    each = scored.select("*", F.posexplode("ids").alias("i", "id")).join(words.select("id", "word"), "id")
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"].cast("string")), " ").alias("phrase")
    whole = each.groupBy("ids", "lang", "a", "l", "r", "n", "score").agg(phrase)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = whole.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return out.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
