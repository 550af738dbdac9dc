"""Operators on small graphs: priorities, cycles, depths, self-loops, differences, snapshots, scalars."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import scalars as S
from lodestone.graph import PropertyGraph
from lodestone.operators import classify, coverage, diff, domains, modules, paths, protocol, stats, traverse
from lodestone.sources import render, snapshots, text


def graph(spark, edges, vertices=()):
    """edges: (src, dst, kind, condition); vertices: (id, kind)."""
    e = spark.createDataFrame([(a, b, *(rest or ("DRIVER", ""))) for a, b, *rest in edges] or [], "src string, dst string, kind string, condition string")
    v = spark.createDataFrame(list(vertices), "id string, kind string")
    return PropertyGraph.of(v, e)


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols or df.columns).collect())


def test_chain(spark):
    g = graph(spark, [("d", "tmp"), ("tmp", "q")])
    assert got(traverse.fan_out(g, traverse.roots(spark, ["d", "tmp"])), "root", "id", "level") == [("d", "q", 2), ("d", "tmp", 1), ("tmp", "q", 1)]
    assert got(traverse.fan_in(g, traverse.roots(spark, ["q"]), 1), "id") == [("tmp",)]


def test_cycles_and_self_loops_end(spark):
    g = graph(spark, [("a", "b"), ("b", "a"), ("b", "b"), ("b", "c")])
    assert got(traverse.closure(g, traverse.roots(spark, ["a"]), "DRIVER"), "id", "level") == [("a", 2), ("b", 1), ("c", 2)]
    assert got(paths.elementary_cycles(g.edges, 3).select(F.array_join("path", ">"))) == [("a>b",), ("b",)]


def test_empty_graph(spark):
    g = graph(spark, [])
    assert got(traverse.fan_out(g, traverse.roots(spark, ["a"]))) == []
    assert got(g.top_edges()) == [] and got(g.degrees()) == [] and got(stats.anomalies(g)) == []
    assert got(paths.simple_paths(g.edges, "a", "b", 3)) == []


def test_parallel_edges_and_priority(spark):
    g = graph(spark, [("a", "b", "DRIVER", "state == RUN"), ("a", "b", "DRIVER", "!rst_n"), ("a", "b", "DRIVER", "x"), ("a", "b", "DRIVER", "x")])
    assert g.edges.count() == 3
    assert [r["condition"] for r in g.edges_between("a", "b").collect()] == ["!rst_n", "x", "state == RUN"]
    assert [r["condition"] for r in g.edges_between("a", "b", ("IDLE", "RUN")).collect()] == ["!rst_n", "state == RUN", "x"]
    assert got(g.top_edges(), "condition") == [("!rst_n",)]


def test_placeholders(spark):
    g = graph(spark, [("top.a", "top.b"), ("4'b10x0", "top.b")], [("top.b", "REG")])
    assert got(g.vertices, "id", "kind", "module") == [("4'b10x0", "CONST", ""), ("top.a", "SIGNAL", "top"), ("top.b", "REG", "")]


def test_paths_and_latency(spark):
    v = [("d", "PORT_IN"), ("a", "REG"), ("b", "REG"), ("q", "REG")]
    g = graph(spark, [("d", "a"), ("a", "b"), ("b", "q"), ("d", "b")], v)
    assert got(paths.simple_paths(g.edges, "d", "q").select(F.array_join("path", ">"))) == [("d>a>b>q",), ("d>b>q",)]
    assert got(paths.shortest_path(g.edges, "d", "q").select(F.array_join("path", ">"))) == [("d>b>q",)]
    assert got(paths.shortest_path(g.edges, "q", "d")) == []
    assert got(paths.latency(paths.simple_paths(g.edges, "d", "q"), g), "n_regs", "latency", "risk") == [(2, 2, "safe"), (3, 3, "safe")]


def test_diff_and_health(spark):
    a, b = graph(spark, [("q", "a")]), graph(spark, [("q", "a"), ("a", "b")])
    assert got(diff.nodes(a, b)) == [("b", "added")] and got(diff.pairs(a, b)) == [("a", "b", "added")]
    assert got(diff.nodes(a, a)) == [] and got(diff.pairs(a, a)) == []
    assert diff.health(a, a).first()["score"] == 10000
    assert got(diff.stable_core(a, b)) == [("q",)]
    assert got(diff.reachability(a, b, traverse.roots(spark, ["q"])), "id", "change") == [("a", "still"), ("b", "newly")]


def test_domains(spark):
    v = [(x, "REG") for x in ("a", "s0", "s1")] + [("c1", "PORT_IN"), ("c2", "PORT_IN")]
    g = graph(spark, [("a", "s0"), ("s0", "s1"), ("c1", "a", "CLOCK", ""), ("c2", "s0", "CLOCK", ""), ("c2", "s1", "CLOCK", "")], v)
    found = domains.crossings(g)
    assert got(found, "src", "dst", "src_domain", "dst_domain") == [("a", "s0", "c1", "c2")]
    assert got(domains.synchronisers(g, found)) == [("s0", 2, "2-FLOP")]


def test_anomalies_and_modules(spark):
    g = graph(spark, [("m.x", "m.y"), ("m.y", "n.z")], [("m.o", "WIRE")])
    assert got(stats.anomalies(g)) == [("m.o", "ORPHAN"), ("m.x", "X_DRIVER"), ("n.z", "DANGLING")]
    assert got(modules.connected(g, "m")) == [("n",)]
    pairs = modules.shared_net_pairs(spark.createDataFrame([(f"i{i}", "n") for i in range(6)], "instance string, net string"))
    assert got(pairs) == [("n", "i0", f"i{i}") for i in range(1, 5)]


def test_state_machine_and_conditions(spark):
    g = graph(spark, [("DONE", "IDLE", "DRIVER", "!!rst_n && state == DONE"), ("x", "y", "DRIVER", "!en"), ("z", "y", "DRIVER", "en")])
    assert ("DONE", "IDLE", "!!rst_n") in got(domains.state_machine(g))
    assert got(domains.opposed(g)) == [("y", "!en", "en")]
    assert "stateDiagram-v2" in list(render.mermaid(domains.state_machine(g)))
    assert list(render.dot(g))[-1] == "}"


CONDITIONS = {"!!rst_n && state == DONE": "state==DONE", "en && a": "a", "state == IDLE": "state == IDLE", "en && !rst_n": "en", "!rst_n && !reset": "!rst_n && !reset", "en && !!rst_n": "!!rst_n"}
NAMES = {"io_m_s_axi_aw_valid": "awvalid", "top.u.data[3]": "data", "aw_bits_data": "awdata", "s_": "s"}


def test_scalars(spark):
    one = lambda values, f: [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(f(F.col("x"))).collect()]
    assert one(CONDITIONS, S.effective_condition) == list(CONDITIONS.values())
    assert one(NAMES, S.normalise) == list(NAMES.values())
    assert [tuple(r) for r in one(["a[7:0]", "d[3]", "x"], S.bit_range)] == [("a", 7, 0), ("d", 3, 3), ("x", None, None)]
    assert one(["0", "1", "8", "9"], lambda c: S.width_class(c.cast("int"))) == ["unknown", "1bit", "small", "wide"]
    assert one(["a.b.c[0].d"], S.last_segments) == ["d"] and one(["a.b.c[0].d"], lambda c: S.last_segments(c, 2)) == ["c[0].d"] and one(["a.b"], lambda c: S.last_segments(c, 0)) == ["a"]
    assert one(["top.awvalid", "tlul.a_valid_i", "x.tready", "foo"], S.channel) == ["AW", "A", "D", "UNKNOWN"]
    assert one(["abc"], lambda c: S.common_prefix(c, F.lit("abd"))) == ["ab"] and one(["x"], lambda c: S.common_prefix(c, F.lit("y"))) == [""]
    assert one(["a && 1 || b_c"], S.condition_signals) == [["a", "b_c"]]


def test_roles_and_protocol(spark):
    s = spark.createDataFrame([("awvalid", 1, "output", "register"), ("awready", 1, "input", ""), ("awaddr", 32, "output", "")], "name string, width int, direction string, driver_kind string")
    assert {r["name"]: r["role"] for r in classify.roles(s).collect()} == {"awvalid": "valid", "awready": "ready", "awaddr": "data"}
    signals = spark.createDataFrame([("m", "aw_valid_o"), ("m", "aw_ready_i"), ("k", "zz")], "module string, name string")
    channels = spark.createDataFrame([("axi", "AW", "awvalid", True), ("axi", "AW", "awready", True)], "protocol string, channel string, signal string, required boolean")
    assert got(protocol.detect(signals, channels)) == [("k", "UNKNOWN", 0), ("m", "axi", 100)]
    g = graph(spark, [("v", "x"), ("x", "r")])
    assert got(protocol.combinational_loops(g, spark.createDataFrame([("v", "r"), ("q", "r")], "valid string, ready string")), "valid", "level") == [("v", 2)]
    assert got(protocol.responses_without_request(g, spark.createDataFrame([("v", "r"), ("q", "r")], "request string, response string"))) == [("q", "r")]


def test_coverage(spark):
    pairs = spark.createDataFrame([("a", "b"), ("c", "a"), ("a", "z")], "a string, b string")
    points = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    assert got(coverage.missing_crosses(pairs, points, spark.createDataFrame([("b", "a")], "a string, b string"))) == [("a", "c")]


def test_snapshots(spark, tmp_path):
    g = graph(spark, [("a", "b", "DRIVER", "x"), ("b", "c")])
    root = f"file://{tmp_path}"
    snapshots.save(g, root, "v1", "abc")
    back = snapshots.load(spark, root, "v1")
    assert got(back.edges) == got(g.edges) and got(back.vertices) == got(g.vertices)
    assert got(snapshots.tags(spark, root), "tag", "node_count", "edge_count") == [("v1", 3, 2)]
    again = snapshots.parse(snapshots.document(g))
    assert got(again.edges) == got(g.edges) and got(again.vertices) == got(g.vertices)
    assert snapshots.delete(spark, root, "v1")


def test_text(spark):
    files = {"/p/a.f": "// c\nx.sv\n-f sub/b.f\n+incdir+inc\n${D}/y.sv\n-f a.f", "/p/sub/b.f": "z.sv\n-f ../a.f\n+define+N=1"}
    out = text.expand_filelist("/p/a.f", lambda p: files.get(p, ""), {"D": "/d"})
    assert out["files"] == ["/p/x.sv", "/p/sub/z.sv", "/d/y.sv"] and out["incdirs"] == ["/p/inc"] and out["defines"] == ["N=1"]
    df = spark.createDataFrame([(1, "a\nFoo\nb"), (2, None), (3, "")], "id int, t string")
    assert got(text.search(df, "id", "t", "foo", 1, ignore_case=True)) == [(1, 2, "Foo", "a", "b")]


def test_fan_in_and_out_agree(spark):
    g = graph(spark, [(f"v{i % 7}", f"v{i * 3 % 11}") for i in range(1, 30)])
    ids = [f"v{i}" for i in range(11)]
    out = set(got(traverse.fan_out(g, traverse.roots(spark, ids)), "root", "id"))
    into = {(b, a) for a, b in got(traverse.fan_in(g, traverse.roots(spark, ids)), "root", "id")}
    assert out == into


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_reach_grows_with_depth(spark, depth):
    g = graph(spark, [(f"n{i}", f"n{(i * 2) % 9}") for i in range(9)])
    less, more = (set(got(traverse.fan_out(g, traverse.roots(spark, ["n1"]), d), "id")) for d in (depth, depth + 1))
    assert less <= more
