"""The pipeline against a plain version of its stages over the smallest tables."""

import os

import brute
import oracle
import pytest

import corpus_pipeline
from lodestone.llm import queries

SF = "/root/testdata/sf0.001"
needs = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@needs
def test_stages(spark):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, SF)
        if name != "tokens":
            assert set(out.columns) == set(corpus_pipeline.COLUMNS)
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = (before, {r["doc_id"]: r for r in docs.collect()})
    before, after = seen["language"]
    assert len(after) >= 0.97 * len(before)
    before, after = seen["near_duplicates"]
    assert set(after) == {c for _, _, c in brute.op6(list(before.items()))}
    before, after = seen["repeated_bytes"]
    want = {d: (n, gone) for d, n, gone, _, _ in brute.op4(list(before.items()))}
    assert set(after) == {d for d, (n, gone) in want.items() if gone < n or n == 0 or gone == 0}
    assert all(len(after[d]["text"].encode()) <= n - gone for d, (n, gone) in want.items() if d in after)
    before, after = seen["decontaminated"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(after) == {r[0] for r in brute.op8(list(before.items()), items) if not r[5]}
    before, after = seen["tokens"]
    assert set(after) == set(before) and all(r["round_trip"] for r in after.values())


@needs
@pytest.mark.parametrize("name", [n for n, (_, sql) in queries.QUERIES.items() if sql])
def test_sql(spark, name):
    query, sql = queries.QUERIES[name]
    assert oracle.compare(query(spark, SF), oracle.connect(SF), sql) == ""
