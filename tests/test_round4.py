"""Walks that take fewer rounds, and store and shuffle less, than a level each: the same rows as level by level."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestone import storage
from lodestone.graph import PropertyGraph
from lodestone.operators import decompose, traverse


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def links(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


@pytest.mark.parametrize("factor", [0, 8, 10**9])
def test_ways_of_all_are_those_of_each(spark, monkeypatch, factor):
    monkeypatch.setattr(traverse, "FACTOR", factor)
    rng = random.Random(factor)
    pairs = [(f"v{rng.randrange(30)}", f"v{rng.randrange(30)}") for _ in range(45)] + [("a", "a"), ("b", "c"), ("c", "b")]
    edges = links(spark, pairs)
    each = traverse.reach(edges, edges.select(F.col("src").alias("root"), F.col("src").alias("id")))
    assert got(traverse.from_all(edges)) == got(each.select("root", "id", "level"))


def test_atoms_of_every_vertex_take_few_rounds(spark):
    """a chain of 70 has 69 levels, and seven rounds."""
    e = spark.createDataFrame([(f"m.v{i}", f"m.v{i + 1}", f"m.v{i} == 1", f"m.v{i}") for i in range(70)], "src string, dst string, condition string, expression string")
    g = PropertyGraph.of(spark.createDataFrame([(f"m.v{i}", "WIRE") for i in range(71)], "id string, kind string"), e)
    before = len(storage._made)
    rows = decompose.atoms(g, g.vertices.select(F.col("id").alias("root")), None).where("root = 'm.v70'")
    assert got(rows.select("atom", "level")) == sorted((f"m.v{i}", 69 - i) for i in range(70))
    assert len(storage._made) - before < 30


def test_few_paths_are_traced_where_visits_lie(spark, monkeypatch):
    """visits aren't put into buckets again for a handful of targets, and a step up is one join."""
    from lodestone.operators import timing

    monkeypatch.setattr(timing, "bucketed", lambda *a: pytest.fail("visits are written again"))
    visits = storage.stored(spark.createDataFrame([("a", None, 0), ("b", "a", 1), ("c", "b", 2)], "id string, parent string, hops bigint"))
    before = len(storage._made)
    found = timing.traced(visits, spark.createDataFrame([("c",), ("a",), ("x",)], "id string"), True)
    assert len(storage._made) - before == 4
    assert got(found) == [("a", 0, "a"), ("c", 0, "a"), ("c", 1, "b"), ("c", 2, "c")]


def test_steps_are_shuffled_once_to_their_sources(spark, monkeypatch):
    """edges that lie in buckets of their ends aren't stored or shuffled to these again, and steps go to sources in one shuffle."""
    from lodestone.operators import timing

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans, put = [], storage.placed
        see = lambda df, *more: (plans.append(df._jdf.queryExecution().executedPlan().toString()) if "dst" in df.columns else None, put(df, *more))[1]
        monkeypatch.setattr(timing, "placed", see)
        monkeypatch.setattr(timing, "counted", lambda *a: pytest.fail("the edges are stored again"))
        edges, _ = storage.placed(links(spark, [("a", "b"), ("b", "c"), ("c", "a")]).repartition(4, "dst"), "dst", 4)
        ones = spark.createDataFrame([(x, 1) for x in "abc"], "id string, w int")
        assert got(timing.first_visits(edges, ones.where("id = 'a'"), ones, True)) == [("a", 0, None, 0), ("b", 1, "a", 1), ("c", 2, "b", 2)]
        assert len(plans) == 1 and plans[0].count("Exchange") == 2  # the edges and the counts
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_drivers_of_few_need_rules_of_few(spark, monkeypatch):
    """rules are made of what lies before the starts only, and give the same drivers as rules of all edges."""
    from lodestone.operators import search

    rng = random.Random(4)
    names = [f"m.u{i}.{x}" for i in range(6) for x in ("q", "d", "o")] + [f"w{i}" for i in range(6)] + ["def.o", "def.i"]
    kinds = {n: rng.choice(["REG", "PORT_OUT", "PORT_IN", "SIGNAL", "WIRE"]) for n in names}
    edges = [(rng.choice(names), rng.choice(names), rng.choice(["DRIVER", "CONNECTION", "CONNECTION", "CLOCK"])) for _ in range(40)] + [("lone", "lonely", "DRIVER")]
    g = PropertyGraph.of(spark.createDataFrame(list(kinds.items()), "id string, kind string"), spark.createDataFrame(edges, "src string, dst string, kind string"))
    g = g.materialised()
    ports = spark.createDataFrame([(f"m.u{i}.o", "def.o") for i in range(6)], "inst_port string, def_port string")
    starts = traverse.roots(spark, ["w0", "w1", "m.u0.q", "def.o"])
    for depth, p in ((None, None), (None, ports), (2, ports), (2, None), (1, None)):
        assert got(search.drivers_of(g, starts, depth, p)) == got(search.drivers(search.driver_rules(g, p), starts, depth))
    seen, rules = [], search.driver_rules
    monkeypatch.setattr(search, "driver_rules", lambda g, p=None: (seen.append(g.edges.count()), rules(g, p))[1])
    assert got(search.drivers_of(g, traverse.roots(spark, ["lonely"]))) == [("lonely", "lone")] and seen == [1]


def test_few_starts_are_searched_from_at_once(spark, monkeypatch):
    """what leads from starts to ends isn't found out before, unless starts are many; the paths are the same."""
    from lodestone.operators import search

    edges = links(spark, [("s", "a"), ("a", "b"), ("b", "e"), ("s", "x"), ("x", "y"), ("t", "b"), ("t", "e2"), ("y", "s")])
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    asked, inside = [], search.inside
    monkeypatch.setattr(search, "inside", lambda *a: (asked.append(1), inside(*a))[1])
    few = got(search.shortest_paths(edges, ids("s", "t"), ids("e", "e2", "none")))
    assert not asked and len({r[:2] for r in few}) == 3
    monkeypatch.setattr(search, "FEW", 1)
    assert got(search.shortest_paths(edges, ids("s", "t"), ids("e", "e2", "none"))) == few and asked


def test_two_versions_are_walked_at_the_same_time(spark, monkeypatch):
    """each walk waits for the other's begin, and pairs that changed are made once."""
    import threading

    from lodestone.operators import diff

    v = spark.createDataFrame([(x, "WIRE") for x in "pqrst"], "id string, kind string")
    e = lambda *x: spark.createDataFrame([(i, j, "DRIVER") for i, j in x], "src string, dst string, kind string")
    a, b = PropertyGraph.of(v.where("id != 't'"), e("pq", "qr", "rp")), PropertyGraph.of(v.where("id != 's'"), e("tp", "pq"))
    begun, made, reach, pairs = threading.Barrier(2), [], diff.reach, diff.pairs
    monkeypatch.setattr(diff, "reach", lambda *x: (begun.wait(20), reach(*x))[1])
    monkeypatch.setattr(diff, "pairs", lambda *x: (made.append(1), pairs(*x))[1])
    row = diff.compare(a, b).first()
    assert (row.newly, row.no_longer, row.still, row.depth_old, row.depth_new, row.stable) == (2, 0, 0, 1, 3, 0)
    assert len(made) == 1
