"""Levels of a walk must not shuffle what was visited before them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import storage
from lodestone.operators import diff, protocol, search, timing, traverse
from lodestone.storage import Segments, placed


def test_visited_vertices_are_not_shuffled(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ids = lambda a, b: spark.range(a, b).select(F.col("id").cast("string").alias("id")).repartition(4, "id")
        seen = Segments(*placed(ids(0, 10), "id", 4), "id", 4)
        for a in range(10, 90, 10):  # more levels than are kept apart
            seen.add(*placed(ids(a, a + 10), "id", 4))
        assert len(seen.parts) <= Segments.MOST and seen.table().count() == 90
        left = seen.without(ids(85, 95))
        assert left._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
        assert sorted(int(r.id) for r in left.collect()) == list(range(90, 95))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def tables_of(f):
    """What f() returns, and how many tables it wrote."""
    before = len(storage._made)
    return f(), len(storage._made) - before


def test_path_searches_do_not_wait_for_what_lies_behind_the_starts(spark):
    tail = [("s", "m"), ("m", "e"), ("m", "x0"), *((f"x{i}", f"x{i + 1}") for i in range(100)), ("x3", "e2")]
    edges = storage.stored(spark.createDataFrame(tail, "src string, dst string"))
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    got, n = tables_of(lambda: search.shortest_paths(edges, ids("s"), ids("e", "e2")).collect())
    want = {("s", "e"): ["s", "m", "e"], ("s", "e2"): ["s", "m", "x0", "x1", "x2", "x3", "e2"]}
    assert sorted(map(tuple, got)) == sorted((*k, i, x) for k, p in want.items() for i, x in enumerate(p))
    assert n < 60
    got, n = tables_of(lambda: search.between(edges, ids("s"), ids("e")).collect())
    assert sorted(map(tuple, got)) == [("m", "e"), ("s", "m")] and n < 15


def test_steps_to_what_was_visited_are_left_behind(spark, monkeypatch):
    edges = [("a", "b0"), ("a", "b1"), *((f"b{i}", f"c{j}") for i in range(2) for j in range(5)), ("c0", "d"), ("d", "d1"), *((f"z{i}", "c4") for i in range(9))]
    sizes, put = [], storage.placed

    def spy(rows, *more):
        out = put(rows, *more)
        if "dst" in rows.columns:
            sizes.append(out[1])
        return out

    monkeypatch.setattr(timing, "STEPS", 5)
    monkeypatch.setattr(timing, "placed", spy)
    counts = spark.createDataFrame([("b0", 1), ("c0", 2), ("d1", 1)], "id string, w int")
    got = timing.first_visits(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("a",)], "id string"), counts)
    want = [("a", 0, None, 0), ("b0", 1, "a", 1), ("b1", 1, "a", 0), ("c0", 2, "b0", 3), *((f"c{i}", 2, "b0", 1) for i in range(1, 5)), ("d", 3, "c0", 3), ("d1", 4, "d", 4)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sizes == [len(edges), 2]


def test_channels_are_followed_as_one_and_no_further_than_needed(spark):
    import test_graph

    chain = [(f"q{i}", f"q{i + 1}") for i in range(30)]
    g = test_graph.graph(spark, chain)
    pairs = spark.createDataFrame([(f"k{i % 3}", f"q{i}") for i in range(31)], "channel string, ready string")
    got, n = tables_of(lambda: sorted(map(tuple, protocol.cross_channel_loops(g, pairs).collect())))
    assert got == [("k0", "k1"), ("k0", "k2"), ("k1", "k2")] and n < 12
    ask = spark.createDataFrame([("q0", "q5"), ("q0", "q11"), ("q7", "q3"), ("zz", "q9")], "request string, response string")
    assert sorted(map(tuple, protocol.responses_without_request(g, ask).collect())) == [("q0", "q11"), ("q7", "q3"), ("zz", "q9")]
    many = ask.select(F.col("request").alias("valid"), F.col("response").alias("ready"))
    assert [tuple(r) for r in protocol.combinational_loops(g, many).collect()] == [("q0", "q5", 5)]


def test_edges_of_versions_are_made_once(spark, monkeypatch):
    import test_graph

    walked = []
    monkeypatch.setattr(diff, "reach", lambda edges, *more: (walked.append(edges), traverse.reach(edges, *more))[1])
    g = test_graph.graph(spark, [("a", "b"), ("b", "c")])
    assert tuple(diff.impact(g, g, spark.createDataFrame([("a",)], "id string")).first()) == (0, 0, 2, 3, 3)
    assert len(walked) == 2 and not any("Exchange" in e._jdf.queryExecution().executedPlan().toString() for e in walked)
