"""The graph's tables lie in buckets, and so do the levels of large walks: what is there already isn't shuffled again."""

from __future__ import annotations

import random

import pytest
import test_graph
from pyspark.sql import functions as F

from lodestone import storage
from lodestone.operators import decompose, domains, paths, reports, traverse
from lodestone.sources import tables

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def shuffled(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_buckets_grow_with_rows(spark):
    assert storage.parts(spark, 10) == 4 and storage.parts(spark, 9_500_000) == 10


def test_levels_in_buckets_are_grouped_as_one_table(spark):
    ids = lambda d: spark.range(40).select(F.col("id").cast("string").alias("id"), F.lit(d).alias("d")).repartition(4, "id")
    seen = storage.Segments(*storage.placed(ids(0), "id", 4), "id", 4)
    seen.add(*storage.placed(ids(1), "id", 4))
    assert seen.table().groupBy("id").agg(F.max("d").alias("d")).count() == 40


def test_pairs_degrees_and_ends_of_a_graph_shuffle_nothing(shuffled):
    g = tables.trade(shuffled, SF)
    g = type(g)(g.vertices, g.edges, buckets=g.buckets)  # nothing derived yet
    assert "Exchange" not in plan(g.pairs())
    assert "Exchange" not in plan(g.edges.join(g.vertices.select(F.col("id").alias("dst")), "dst", "left_semi"))
    assert plan(g._degrees()).count("Exchange hash") == 1  # sources only
    assert got(g.pairs()) == got(g.top_edges().select("src", "dst"))


def test_crossings_make_top_edges_of_registers_only(spark):
    g = tables.trade(spark, SF)
    g = type(g)(g.vertices, g.edges, buckets=g.buckets)
    found = got(domains.crossings(g).select("src", "dst", "kind", "condition"))
    assert "top ()" not in g.memo and found
    d = domains.assign(g)
    top = g.top_edges().where("kind not in ('CLOCK', 'RESET')").join(d.toDF("src", "a"), "src").join(d.toDF("dst", "b"), "dst").where("a != b")
    assert found == got(top.select("src", "dst", "kind", "condition"))
    assert reports.clock_report(g).count() == g.vertices.where("is_clock").count()


@pytest.mark.parametrize("hashed", [0, 500_000])
def test_wide_walks_reach_the_same(spark, monkeypatch, hashed):
    monkeypatch.setattr(traverse, "WIDE", 3)
    monkeypatch.setattr(traverse, "HASHED", hashed)
    put = []
    monkeypatch.setattr(traverse, "placed", lambda df, by, n: (put.append(by), storage.placed(df, by, n))[1])
    rnd = random.Random(1)
    edges = {(f"v{rnd.randrange(30)}", f"v{rnd.randrange(30)}") for _ in range(50)}
    starts = [(f"r{i}", f"v{i}") for i in range(6)]
    want = []
    for root, s in starts:
        level, seen, now = 0, {}, {s}
        while now:
            level += 1
            now = {b for a, b in edges if a in now} - set(seen)
            seen |= {b: level for b in now}
        want += [(root, b, n) for b, n in seen.items()]
    e, s = spark.createDataFrame(sorted(edges), "src string, dst string"), spark.createDataFrame(starts, "root string, id string")
    assert got(traverse.reach(e, s).select("root", "id", "level")) == sorted(want, key=str)
    assert put[0] == "id" and set(put[1:]) == {("root", "id")} and put.count("id") == 1


def test_stages_of_vertices_that_are_found_nearer_later(spark):
    # s goes to t over three wires or over two registers: by wires it is later, but nearer.
    e = [("s", "r1"), ("r1", "r2"), ("r2", "t"), ("t", "z"), ("s", "w1"), ("w1", "w2"), ("w2", "w3"), ("w3", "t")]
    g = test_graph.graph(spark, e)
    kind = F.when(F.col("id") == "s", "PORT_IN").when(F.col("id").startswith("w"), "WIRE").otherwise("REG")
    g = type(g)(g.vertices.withColumn("kind", kind).withColumn("width_msb", F.lit(7)).withColumn("name", F.lit("q")), g.edges)
    assert got(reports.pipeline_stages(g)) == [("r1", 1), ("r2", 2), ("t", 1), ("z", 2)]
    g = type(g)(g.vertices, g.edges).materialised()
    assert got(reports.pipeline_stages(g)) == [("r1", 1), ("r2", 2), ("t", 1), ("z", 2)]


def test_longest_paths_shuffle_their_steps_once(shuffled, monkeypatch):
    plans, put = [], storage.placed
    monkeypatch.setattr(paths, "placed", lambda df, by, n: (plans.append(plan(df)), put(df, by, n))[1])
    e = shuffled.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], "src string, dst string")
    ones = shuffled.createDataFrame([(x, 1) for x in "abcd"], "id string, w bigint")
    assert got(paths.longest_depth(e, ones.where("id = 'a'").select("id"), ones)) == [("a", 1), ("b", 2), ("c", 3), ("d", 4)]
    assert len(plans) > 3 and all(p.count("Exchange") == 1 for p in plans[2:])


def test_steps_between_atoms_are_made_once(spark, monkeypatch):
    walked = []
    monkeypatch.setattr(decompose, "reach", lambda e, *more: (walked.append(e), traverse.reach(e, *more))[1])
    g = test_graph.graph(spark, [("a", "b", "DRIVER", "a"), ("b", "c", "DRIVER", "b")])
    decompose.atoms(g, g.vertices.select(F.col("id").alias("root")), None).collect()
    assert len(walked) == 1 and "Exchange" not in plan(walked[0])
