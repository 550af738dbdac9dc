"""Plans and groups that must not grow with the input."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.llm import bpe, common, phrases, simhash
from lodestone.llm.components import _star


DOCS = "SELECT * FROM VALUES (1L, 'a b c d'), (2L, 'a b c d'), (3L, 'x y z') AS t(doc_id, text)"


@pytest.fixture
def generous(spark):
    """A session that broadcasts whatever it takes for small."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("BroadcastHashJoin"), plan.count("SortMergeJoin")


def test_simhash_broadcasts_nothing_that_grows(generous):
    fps = generous.sql("SELECT * FROM VALUES (0L), (1L), (3L), (1099511627776L) AS t(fp)")
    assert joins(simhash.links(fps)) == (0, 1)
    edges = generous.sql("SELECT * FROM VALUES (1L, 2L), (2L, 3L) AS t(a, b)")
    assert joins(_star(edges, small=False)) == (0, 1)
    docs = generous.sql(DOCS)
    out = simhash.near_duplicates(docs)
    assert joins(out)[0] == 0
    assert sorted((r.doc_id, r.component_id) for r in out.collect()) == [(1, 1), (2, 1), (3, 3)]


def test_keep_one_broadcasts_nothing_that_grows(generous):
    docs = generous.sql(DOCS)
    out = simhash.keep_one(docs)
    assert joins(out)[0] == 0
    assert sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_scratch_tables_are_written_in_small_groups(spark, tmp_path):
    big = spark.range(0, 48, 1, 1).select("id", F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(1 << 14)), lambda i: F.sha2((i + F.col("id") * 100_000).cast("string").cast("binary"), 256))).cast("binary").alias("b"))
    out = common.written(big, "groups")
    (file,) = [f.removeprefix("file://") for f in out.inputFiles()]
    meta = pq.ParquetFile(file).metadata
    # 48 rows of a megabyte each, half of that as they are compressed.
    assert meta.num_row_groups > 1 and max(meta.row_group(i).num_rows for i in range(meta.num_row_groups)) < 40
    assert out.agg(F.sum(F.octet_length("b"))).first()[0] == 48 << 20


def test_tasks_hold_one_bucket_and_a_bounded_share_of_chunks(spark):
    sent = spark.range(40).select(F.col("id").alias("chunk"), F.array(F.struct(F.lit(0).alias("range"), F.transform(F.sequence(F.lit(0), F.lit(31)), lambda b: F.struct(b.alias("bucket"), F.lit(b"x").alias("blob"))).alias("parts"))).alias("sent"))
    got = common.met(sent, 32, 40, 32).withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == 32 == len({r.task for r in got}) and all(len(r.met) == 40 for r in got)
    rows = spark.range(64).select(F.lit(0).alias("bucket"), F.col("id").alias("chunk"), F.lit(b"x").alias("blob"))
    assert "REPARTITION_BY_NUM" in common.back(rows, 32, 32)._jdf.queryExecution().executedPlan().toString()


def test_numbers_of_chunks_are_the_same_again():
    rng = np.random.default_rng(3)
    for n_units, n in ((0, 0), (1, 1), (9, 4), (50, 200), (300, 120)):
        sizes = rng.integers(0, 4, n_units)
        parts, units = rng.integers(0, 40, sizes.sum()), rng.integers(0, max(n_units, 1), n if n_units else 0)
        ends = np.cumsum(sizes)
        listed = [parts[e - k : e].tolist() for e, k in zip(ends, sizes, strict=True)]
        a, b, own_sizes, words = bpe.numbered(units, parts, sizes)
        at, flat = bpe.plain_numbers(a, b, own_sizes)
        ends = np.cumsum(own_sizes)
        again = [words[flat[e - k : e]].tolist() for e, k in zip(ends, own_sizes, strict=True)]
        assert [again[i] for i in at] == [listed[i] for i in units] and len(set(words)) == len(words)


def test_bpe_stores_less_than_its_text(spark):
    """What the chunks of a text of rare and frequent words take: 0.111 of it, where it was 0.120."""
    rng = np.random.default_rng(7)
    sound = ["ka", "to", "mi", "re", "sul", "ven", "dor", "pa", "qui", "ze"]
    names = ["".join(rng.choice(sound, rng.integers(1, 5))) + str(i % 97) * (i % 3 == 0) for i in range(60_000)]
    rows = [(i, " ".join(names[j] for j in np.minimum(rng.zipf(1.25, 400), len(names)) - 1)) for i in range(900)]
    first = len(common._made)
    out = bpe.encode(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), {bytes([i]): i for i in range(256)}, r" ?\w+|\s+", decode=False)
    text = sum(len(t) for _, t in rows)
    assert out.agg(F.sum("n_tokens")).first()[0] == text
    sizes = [sum(Path(f.removeprefix("file://")).stat().st_size for f in spark.read.parquet(path).inputFiles()) for _, path in common._made[first:] if "/chunks-" in path]
    assert len(sizes) == 1 and sizes[0] < 0.115 * text, sizes[0] / text


def test_words_of_phrases_are_answered_not_joined(spark, monkeypatch):
    """Rows of chunks and words grew 12 times with five times the text, as more words reach the threshold: each word that is asked
    for gets an answer now, whatever the threshold."""
    plans = []
    monkeypatch.setattr(phrases, "answers_of", lambda chunks, per: (plans.append(per._jdf.queryExecution().executedPlan().toString()), common.answers_of(chunks, per))[1])
    monkeypatch.setattr(phrases, "CHUNK", 300)
    rows = [(f"a b c{i % 7} d{i}. a b", "en" if i % 2 else None) for i in range(200)]
    first = len(common._made)
    words, totals, _ = phrases.phrases(spark.createDataFrame(rows, "text string, lang string"), "text", "lang", 20, 5, 10**6)
    assert plans and not any("Join" in p for p in plans)
    # What was split is gone once words have their ids; the rest is there.
    assert not [m for m in common._made[first:] if "/chunks-" in m[1]] and [m for m in common._made[first:] if "/coded-" in m[1]]
    got = words.collect()
    assert len({r.id for r in got}) == len(got) and {(r.lang, bytes(r.word), r.f) for r in got if r.word in (b"a", b"b")} == {(x, w, 200) for x in ("en", "und") for w in (b"a", b"b")}
    assert sorted(map(tuple, totals.collect())) == [("en", 600), ("und", 600)]
