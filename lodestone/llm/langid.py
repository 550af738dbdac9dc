"""Language identification by nearest centroids of normalised TF-IDF n-gram vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, written

#: Buckets of hashed byte trigrams.
DIMS = 1 << 13
#: Bound of the sample that a model is fitted on: distinct texts of each language. Longer texts than so many bytes are taken
#: only where a language has too few others.
TRAIN_PER_LANG, TRAIN_TEXT_BYTES = 600, 20_000
LANES = 16  # in which a label's texts are ranked first; the last step reads at most LANES * TRAIN_PER_LANG of each label
CENTROIDS, ROUNDS = 4, 12


@dataclass
class Model:
    idf: np.ndarray  # by bucket
    centroids: np.ndarray  # unit rows
    langs: list[str]  # of each centroid
    least: np.ndarray  # of each centroid: below this cosine a text is rejected


def has_letter(text: str) -> bool:
    """Whether a text has a letter (Unicode's category L, as in fit(): numerals such as the half sign or Roman ones aren't)."""
    return any(map(str.isalpha, text))


def counts(texts: list[bytes]) -> np.ndarray:
    """Hashed trigram counts of whole texts, a row each."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.zeros((len(texts), DIMS), np.float32)
    b = np.frombuffer(b"".join(texts), np.uint8)
    if len(b) < 3:
        return out
    b = b.astype(np.uint32)
    x = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    x = (x >> np.uint32(19)).astype(np.int64)
    ends = np.cumsum(lens)
    for i, (start, end) in enumerate(zip((ends - lens).tolist(), ends.tolist(), strict=True)):
        if end - start >= 3:
            out[i] = np.bincount(x[start : end - 2], minlength=DIMS)
    return out


def vectors(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(rows) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


#: White space as spaces; what else of ASCII is no letter says nothing about a language, and goes.
BLANK = bytes(32 if i < 128 and chr(i).isspace() else i for i in range(256))
NO_LETTER = bytes(i for i in range(128) if not chr(i).isalpha() and not chr(i).isspace())


def prepared(text: str) -> bytes:
    """A text as n-grams are taken from it, between spaces, so that a single letter has one too."""
    return b" " + text.lower().encode("utf-8", "replace").translate(BLANK, NO_LETTER) + b" "


def _groups(texts: list[str | None], most: int = 1 << 21) -> Iterator[list[int]]:
    held, size = [], 0
    for i, t in enumerate(texts):
        held.append(i)
        size += len(t or "") + 4096
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _kmeans(v: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from a farthest-point start; deterministic."""
    mean = v.mean(axis=0)
    picked = [int(np.argmax(v @ mean))]
    while len(picked) < min(k, len(v)):
        near = (v @ v[picked].T).max(axis=1)
        picked.append(int(np.argmin(near)))
    c = v[picked]
    for _ in range(ROUNDS):
        own = np.argmax(v @ c.T, axis=1)
        c = np.stack([v[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", centroids: int = CENTROIDS, slack: float = 0.5) -> Model:
    """A model of the labelled rows of df. Of each label at most TRAIN_PER_LANG distinct texts are used, the first by a hash
    of the text, those of over TRAIN_TEXT_BYTES bytes behind all others, so every label that has a text with a letter is
    learned, however often it is copied or however long it is. Rows with a null label, no text or no letter are not used;
    other columns are not read. slack scales the smallest cosine that a centroid accepts: the first percentile of its own
    training texts. Each label's centroids are found in a task of its own, which holds its sample as vectors; the driver gets
    them, DIMS floats each, and the document frequencies.
    """
    from pyspark.sql import Window

    spark = df.sparkSession
    ship(spark)
    text = F.col(f"`{text_col}`")
    usable = df.select(F.col(f"`{lang_col}`").cast("string").alias("l"), text.alias("t")).where(F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}"))
    named = usable.select("l", "t", F.xxhash64("t").alias("h"))
    # Distinct texts are ranked by their hashes; texts themselves are only read again for those that are chosen.
    distinct = named.select("l", "h", (F.octet_length("t") > TRAIN_TEXT_BYTES).alias("long")).distinct()
    # The first of a label are among the first of its lanes, so no task ranks a whole label.
    chosen = distinct.withColumn("lane", F.pmod("h", F.lit(LANES)))
    for by in (("l", "lane"), ("l",)):
        chosen = chosen.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("long", "h"))).where(F.col("r") <= TRAIN_PER_LANG)
    chosen = chosen.select("l", "h")
    sample = named.join(chosen, ["l", "h"]).groupBy("l", "h").agg(F.min("t").alias("t"))

    def run(batches):
        for b in batches:
            labels, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for g in _groups(texts):
                rows = counts([prepared(texts[i]) for i in g])
                sparse = [(np.flatnonzero(r), r) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([labels[i] for i in g], pa.string()), pa.array([i.tolist() for i, _ in sparse], pa.list_(pa.int32())), pa.array([r[i].astype("<f4").tobytes() for i, r in sparse], pa.binary())], names=["l", "i", "v"])

    rows = written(sample.select("l", "t").mapInArrow(run, "l string, i array<int>, v binary"), "trigrams")
    n, held = rows.count(), np.zeros(DIMS)
    for r in rows.select(F.explode("i").alias("i")).groupBy("i").agg(F.count("*").alias("c")).collect():  # DIMS rows at most
        held[r["i"]] = r["c"]
    idf = np.log((1 + n) / (1 + held)).astype(np.float32) + np.float32(0.1)

    def cluster(got: pa.Table) -> pa.Table:
        i, v = got.column("i").to_pylist(), got.column("v").to_pylist()
        m = np.zeros((len(i), DIMS), np.float32)
        for n, k in enumerate(sorted(range(len(i)), key=lambda k: (i[k], v[k]))):
            m[n, i[k]] = np.frombuffer(v[k], "<f4")
        own = vectors(m, idf)
        c = _kmeans(own, centroids)
        near = own @ c.T
        nearest = near.argmax(axis=1)
        low = np.quantile(near.max(axis=1), 0.01)
        least = [slack * min(low, np.quantile(near[nearest == j, j], 0.01) if (nearest == j).any() else low) for j in range(len(c))]
        lang = got.column("l")[0].as_py()
        return pa.table({"l": [lang] * len(c), "j": pa.array(range(len(c)), pa.int32()), "c": [x.astype("<f4").tobytes() for x in c], "least": [float(x) for x in least]})

    made = sorted(map(tuple, rows.groupBy("l").applyInArrow(cluster, "l string, j int, c binary, least double").collect()))
    return Model(idf, np.array([np.frombuffer(c, "<f4") for _, _, c, _ in made], np.float32).reshape(-1, DIMS), [x[0] for x in made], np.array([x[3] for x in made], np.float32))


def classify(texts: list[str | None], m: Model) -> tuple[list[str], list[float], list[bool]]:
    """Language, cosine to its nearest centroid (0 to 1), and whether that is too far: `und`, 0 and True for null texts,
    for texts without a letter, and for a model without languages. Of equal cosines the first label counts."""
    langs, scores, far = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
    for g in _groups(texts):
        g = [i for i in g if m.langs and texts[i] is not None and has_letter(texts[i])]
        if not g:
            continue
        near = vectors(counts([prepared(texts[i]) for i in g]), m.idf) @ m.centroids.T
        best = near.argmax(axis=1)
        for i, b, s in zip(g, best.tolist(), near.max(axis=1).tolist(), strict=True):
            langs[i], scores[i], far[i] = m.langs[b], min(1.0, max(0.0, s)), s < m.least[b]
    return langs, scores, far


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df and lang_pred, score, lang_rejected (columns of these names in df are replaced). Whole texts are read; every row
    stays, repeated ones included. A text too far from every centroid keeps its nearest language and is rejected."""
    ship(df.sparkSession)
    names = ("lang_pred", "score", "lang_rejected")
    base = df.drop(*names)
    at = base.columns.index(text_col)
    shared = df.sparkSession.sparkContext.broadcast(model)  # centroids x DIMS floats: a size fixed by the parameters and the number of labels
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields) + ", lang_pred string, score double, lang_rejected boolean"

    def run(batches):
        for b in batches:
            langs, scores, far = classify(b.column(at).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(far, pa.bool_())], names=[*b.schema.names, *names])

    return base.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from training; one without an id isn't."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))
