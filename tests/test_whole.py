"""Queries over whole tables and to the end of their walks, against plain Python: no SQL that may have a cut in it."""

import os

import pytest
import test_graph

from lodestone.operators import domains, paths
from lodestone.plans import catalog

SF = "/root/testdata/sf0.001"
needs = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def rows(spark, table, *cols):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{table}.parquet").select(*cols).collect()]


def test_longest_depth_to_the_end(spark):
    chain = [(f"q{i}", f"q{i + 1}") for i in range(12)] + [("a", "q0"), ("a", "q5")]
    g = test_graph.graph(spark, chain)
    weight = g.vertices.selectExpr("id", "cast(1 as bigint) as w")
    start = spark.createDataFrame([("a",)], "id string")
    assert dict(map(tuple, paths.longest_depth(g.edges, start, weight).collect())) == {"a": 1} | {f"q{i}": i + 2 for i in range(13)}
    loop = test_graph.graph(spark, [*chain, ("q3", "q2")])
    with pytest.raises(ValueError, match="cycle"):
        paths.longest_depth(loop.edges, start, weight)


@needs
def test_reg_depth(spark):
    want = {f"c.{c}": 0 for (c,) in rows(spark, "customer", "c_custkey")}
    at = {}
    for c, _, o in sorted(rows(spark, "orders", "o_custkey", "o_orderdate", "o_orderkey")):
        at[c] = at.get(c, 0) + 1
        want[f"o.{o}"] = at[c]
    assert max(want.values()) > 4
    assert dict(map(tuple, catalog.QUERIES["reg_depth"][0](spark, SF).select("id", "depth").collect())) == want


def test_synchronisers_to_the_end(spark):
    regs = [f"s{i}" for i in range(10)]
    v = [(x, "REG") for x in ["a", *regs]] + [("c1", "PORT_IN"), ("c2", "PORT_IN")]
    g = test_graph.graph(spark, [("a", "s0"), *zip(regs, regs[1:]), ("s9", "s4"), ("c1", "a", "CLOCK", ""), *[("c2", x, "CLOCK", "") for x in regs]], v)
    assert test_graph.got(domains.synchronisers(g, domains.crossings(g))) == [("s0", 10, "10-FLOP")]
    assert test_graph.got(domains.synchronisers(g, domains.crossings(g), 3)) == [("s0", 4, "4-FLOP")]


@needs
def test_sync_chain(spark):
    orders, want, of = rows(spark, "orders", "o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus"), {}, {}
    for c, _, o, s in sorted(orders):
        of.setdefault(c, []).append((f"o.{o}", s))
    for chain in of.values():
        for i in range(1, len(chain)):
            if chain[i][1] != chain[i - 1][1]:
                n = 1
                while i + n < len(chain) and chain[i + n][1] == chain[i][1]:
                    n += 1
                want[chain[i][0]] = n
    assert dict(map(tuple, catalog.QUERIES["sync_chain"][0](spark, SF).select("dst", "n_regs").collect())) == want


@needs
def test_handshake_pairs(spark):
    names = {(m, f"b{c % 7}", "_valid" if o % 2 == 0 else "_ready") for m, c, o in rows(spark, "orders", "o_orderpriority", "o_custkey", "o_orderkey")}
    want = sorted((m, b, b + "_valid", b + "_ready") for m, b, end in names if end == "_valid" and (m, b, "_ready") in names)
    assert test_graph.got(catalog.QUERIES["handshake_pairs"][0](spark, SF), "module", "base", "valid", "ready") == want
