"""Ports, passes, handshakes, protocol scores and reports on small graphs."""

import os

import oracle
import pytest
from pyspark.sql import functions as F
from test_graph import got, graph

from lodestone.functions import scalars as S
from lodestone.graph import PropertyGraph
from lodestone.operators import classify, coverage, domains, handshake, modules, passes, paths, ports, protocol, reports, traverse
from lodestone.plans import reports as plans  # noqa: F401  registers its queries
from lodestone.plans.catalog import QUERIES
from lodestone.sources import tables, text

SF = "/root/testdata/sf0.001"


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def test_paths_without_a_bound(spark):
    g = graph(spark, [(f"a{i:02}", f"a{i + 1:02}") for i in range(13)])
    assert len(paths.shortest_path(g.edges, "a00", "a13").first()["path"]) == 14
    assert got(paths.shortest_path(g.edges, "a00", "a13", 12)) == [] and got(paths.shortest_path(g.edges, "a00", "a00")) == [(["a00"],)]
    ring = graph(spark, [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)])
    assert [len(r["path"]) for r in paths.elementary_cycles(ring.edges).collect()] == [7]


def test_placeholders_and_literals(spark):
    g = graph(spark, [("top.u.a", "x'y"), ("12", "top.b"), ("4'b10x0", "3abc")])
    assert got(g.vertices, "id", "name", "module", "kind") == [("12", "12", "", "CONST"), ("3abc", "3abc", "3abc", "SIGNAL"), ("4'b10x0", "4'b10x0", "", "CONST"), ("top.b", "b", "top", "SIGNAL"), ("top.u.a", "u.a", "top", "SIGNAL"), ("x'y", "x'y", "x'y", "SIGNAL")]


def test_globs_are_literal(spark):
    v = graph(spark, [], [("a(1)+", "REG"), ("a1", "REG"), ("ab|c", "REG"), ("[!x]", "REG")]).vertices
    ids = lambda p: [r[0] for r in got(modules.filtered(v, exclude=p), "id")]
    assert ids("a(1)+") == ["[!x]", "a1", "ab|c"] and ids("a?") == ["[!x]", "a(1)+", "ab|c"] and ids("*|c") == ["[!x]", "a(1)+", "a1"] and ids("[!x]") == ["a(1)+", "a1", "ab|c"]


def test_macros_to_the_end(spark):
    lines = [f"`define M{i} `M{i + 1}" for i in range(9)] + ["`define M9 done", "`define A `B", "`define B `A + $x", "use `M0 `A `NO"]
    files = frame(spark, [("f", "\n".join(lines))], "path string, text string")
    table = text.macros(files)
    found = dict(map(tuple, table.collect()))
    assert found["M0"] == "done" and found["A"] == "`A + $x" and found["B"] == "`B + $x"
    assert text.substitute(files, table).first()["text"].split("\n")[-1] == "use done `A + $x `NO"
    assert got(text.macros(files.limit(0))) == []


def test_components(spark):
    g = graph(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("x", "a"), ("q", "q")])
    assert got(domains.components(g.edges)) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")]
    assert got(domains.condensed(g.edges)) == [("a", "d"), ("d", "f"), ("x", "a")]
    # A way round that only meets at a later vertex: colours have to be taken more than once.
    h = graph(spark, [("a", "m"), ("m", "n"), ("n", "m"), ("n", "z"), ("z", "y"), ("y", "z"), ("b", "a"), ("a", "b")])
    assert got(domains.components(h.edges)) == [("a", "a"), ("b", "a"), ("m", "m"), ("n", "m"), ("y", "y"), ("z", "y")]
    assert got(domains.components(graph(spark, []).edges)) == []


def test_layers_and_stages(spark):
    v = [("i", "PORT_IN"), ("a", "REG"), ("b", "REG"), ("c", "WIRE"), ("o", "PORT_OUT"), ("z", "REG")]
    g = graph(spark, [("i", "a"), ("a", "b"), ("i", "c"), ("b", "c"), ("c", "b"), ("c", "o")], v)
    assert dict(got(reports.layers(g))) == {"i": 0, "a": 1, "b": 2, "c": 2, "o": 3, "z": 0}
    wide = PropertyGraph(g.vertices.withColumn("width_msb", F.lit(7)).withColumn("name", F.lit("q")), g.edges)
    assert dict(got(reports.pipeline_stages(wide))) == {"a": 1, "b": 1, "z": 2}
    loop = graph(spark, [("s", "s")], [("s", "REG"), ("fsm_x", "REG")])
    assert dict(got(reports.pipeline_registers(loop), "id", "role"))["s"] == "state"


def test_ports(spark):
    g = graph(spark, [("top.a", "top.u.d"), ("dut.d", "dut.q")])
    p = frame(spark, [("top.u.d", "top.u", "dut.d"), ("top.v.d", "top.v", "dut.d"), ("top.u.q", "top.u", "dut.q")], "inst_port string, instance string, internal string")
    ids = frame(spark, [("top.u.d", "top.u.d"), ("dut.q", "dut.q"), ("top.a", "top.a")], "root string, id string")
    assert got(ports.loads(g, p, ids)) == [("dut.q", "top.u.q"), ("top.a", "top.u.d"), ("top.u.d", "dut.d")]
    assert got(ports.drivers(g, p, frame(spark, [("top.v.d", "top.v.d"), ("dut.q", "dut.q")], "root string, id string"))) == [("dut.q", "dut.d"), ("top.v.d", "dut.d"), ("top.v.d", "top.u.d")]
    assert ports.connection(g, p, "top.a", "dut.q").first()["path"] == ["top.a", "top.u.d", "dut.d", "dut.q"]
    assert dict(got(ports.resolve(p, frame(spark, [("top.u.q",), ("dut.d",), ("v.d",), ("no",)], "id string")))) == {"top.u.q": "dut.q", "dut.d": "dut.d", "v.d": "dut.d", "no": "no"}
    assert got(ports.internal(p, ids, frame(spark, [("top.u.d", "mine")], "inst_port string, internal string"))) == [("top.u.d", "mine")]
    clk = PropertyGraph.of(frame(spark, [("top.clk_i",), ("top.u.v.clk",)], "id string"), frame(spark, [], "src string, dst string"))
    c = frame(spark, [("top.clk_i", "top", "dut.clk"), ("top.w.clk", "top.w", "dut.clk")], "inst_port string, instance string, internal string")
    assert got(ports.clock_nets(clk, c)) == [("domain.clk_i", "dut.clk"), ("domain.clk_i", "top.clk_i"), ("domain.clk_i", "top.w.clk")]
    inst = frame(spark, [("m.a", "x", "m"), ("m.a", "x", "m"), ("m.a.b", "y", "m.a")], "id string, module_type string, parent string")
    assert got(ports.distinct_instances(inst, "m")) == [("m.a", "x", "m")] and got(ports.below(inst, "m", 1)) == [("m.a", 1)]


def test_passes(spark):
    g = graph(spark, [("top.w.p", "x"), ("a", "b")], [("top.w.p", "PORT_IN"), ("top.w.u.p", "PORT_IN"), ("top.w.o", "PORT_OUT"), ("top.w.u.o", "PORT_OUT"), ("v[3:0]", "REG")])
    inst = frame(spark, [("top.w",), ("top.w.u",)], "id string")
    new = passes.passthroughs(g, inst)
    assert got(new.edges.where("assign_type = 'connection'"), "src", "dst") == [("top.w.p", "top.w.u.p"), ("top.w.u.o", "top.w.o")]
    assert got(passes.bit_parents(g).vertices.where("id like 'v%'"), "id", "kind") == [("v", "SIGNAL"), ("v[3:0]", "REG")]
    assert got(passes.bit_spans(g)) == [("v[3:0]", "v", 3, 0, 4)]
    s = graph(spark, [("p", "q")], [(x, "SIGNAL") for x in ("p", "q", "p.a", "p.b")])
    assert got(passes.expand_structs(s).edges, "src", "dst", "kind") == [("p", "q", "DRIVER"), ("p.a", "p", "BIT_SELECT"), ("p.a", "q.a", "DRIVER"), ("p.b", "p", "BIT_SELECT"), ("p.b", "q.b", "DRIVER"), ("q.a", "q", "BIT_SELECT"), ("q.b", "q", "BIT_SELECT")]
    v = frame(spark, [("a", "", 0), ("b", "f", 3)], "id string, file string, line int")
    assert got(passes.filled(v, frame(spark, [("a", "g", 7), ("b", "h", 1)], "id string, file string, line int"))) == [("a", "g", 7), ("b", "f", 3)]
    assert got(passes.with_directions(v, frame(spark, [("a", "input")], "id string, modport_dir string")), "id", "modport_dir") == [("a", "input"), ("b", "")]


def test_hierarchy(spark):
    p = frame(spark, [("b", "a"), ("c", "b"), ("d", "b"), ("a", None)], "id string, parent string")
    assert got(traverse.subclasses(p, "b")) == [("c",), ("d",)] and got(traverse.descendants(p, "a")) == [("b", 1), ("c", 2), ("d", 2)]
    assert got(traverse.depths(p)) == [("a", 0, "a"), ("b", 1, "a"), ("c", 2, "a"), ("d", 2, "a")]
    assert got(traverse.is_ancestor(p, frame(spark, [("a", "c"), ("c", "a")], "ancestor string, descendant string"))) == [("a", "c")]


def test_full_expressions(spark):
    e = frame(spark, [("rx", "d", "{rx, q[3:1]}"), ("d", "q", "d"), ("q", "o", "q"), ("m", "n", "m"), ("n", "m", "n"), ("5'b0", "z", "5'b0")], "src string, dst string, expression string")
    g = PropertyGraph.of(frame(spark, [], "id string"), e)
    full = dict(got(reports.full_expressions(g, frame(spark, [("o",), ("q",), ("rx",), ("m",), ("z",), ("5'b0",)], "id string"))))
    assert full == {"o": "{rx, q[3:1]}", "q": "{rx, q[3:1]}", "rx": "", "m": "n", "z": "5'b0", "5'b0": ""} or full["m"] in ("n", "m")
    d = {(r["id"], r["driver"]): r for r in reports.driver_details(g, traverse.roots(spark, ["o"])).collect()}
    assert d["o", "q"]["expression"] == "{rx, q[3:1]}" and d["o", "q"]["level"] == 1 and d["o", "rx"]["expression"] == "" and set(b for _, b in d) == {"q", "d", "rx"}


def test_handshakes(spark):
    rows = [("", "", ""), ("", "!fifo_full || x", "continuous"), ("", "src", "continuous"), ("", "1'b1", "always_comb"), ("a_valid && a_ready", "", ""), ("x_req || y_req", "", ""), ("!rx_empty", "", ""), ("", "nxt", "always_ff"), ("en", "", ""), ("", "x", "blocking")]
    want = ["PORT_PASSTHROUGH", "COMBINATIONAL_BP", "WIRE_PASSTHROUGH", "PORT_PASSTHROUGH", "STANDARD_AXI", "COMPLEX_ARB", "COMBINATIONAL_BP", "REGISTERED_BP", "CONDITIONAL_CTRL", None]
    df = frame(spark, [(i, *r) for i, r in enumerate(rows)], "i int, c string, e string, t string")
    assert [r[1] for r in got(df.select("i", handshake.driver_class(F.col("c"), F.col("e"), F.col("t"))))] == want
    signals = frame(spark, [("u.a_ready_o", "SIGNAL"), ("u.b_ready", "PORT_IN"), ("u.c_ready", "SIGNAL"), ("u.d_ready", "SIGNAL"), ("u.a_valid_i", "PORT_IN")], "id string, kind string")
    drivers = frame(spark, [("u.a_ready_o", "en", "", ""), ("u.a_ready_o", "a_valid && a_ready", "", ""), ("u.d_ready", "", "x", "blocking")], "id string, condition string, expression string, assign_type string")
    kinds = {r["id"]: r["handshake"] for r in handshake.classify(signals, drivers).collect()}
    assert kinds == {"u.a_ready_o": "STANDARD_AXI", "u.b_ready": "PORT_PASSTHROUGH", "u.c_ready": "UNUSED", "u.d_ready": "UNKNOWN", "u.a_valid_i": "PORT_PASSTHROUGH"}
    assert got(handshake.scan(signals, drivers)) == [("u.a_valid_i", "u.a_ready_o", "STANDARD_AXI", "A")]
    assert got(handshake.layers(signals, {"A": ("a_",), "B": ("b_",)}, 1)) == [("u.a_ready_o", "A"), ("u.b_ready", "B"), ("u.c_ready", "OTHER")]
    names = frame(spark, [("m_awvalid", "m_awready"), ("xvalid", "y"), ("p", "q")], "v string, r string").select(handshake.by_name(F.col("v"), F.col("r")).alias("h"))
    assert [r["h"] and tuple(r["h"]) for r in names.collect()] == [("STANDARD_AXI", "AW"), ("WIRE_PASSTHROUGH", "UNKNOWN"), None]


AXI = [("m", "awvalid", 1, "output", "register"), ("m", "awready", 1, "input", ""), ("m", "awaddr", 32, "output", ""), ("k", "zz", 1, "input", "")]
SIGNALS = "module string, name string, width int, direction string, driver_kind string"


def test_protocol_scores(spark):
    s = frame(spark, AXI, SIGNALS)
    channels = frame(spark, [("axi", "AW", "awvalid", True), ("axi", "AW", "awready", True), ("axi", "AW", "awaddr", True), ("axi", "W", "wvalid", True)], "protocol string, channel string, signal string, required boolean")
    roles = frame(spark, [("axi", "awvalid", "valid"), ("axi", "awready", "ready"), ("axi", "awaddr", "addr")], "protocol string, signal string, role string")
    out = protocol.score(s, channels, roles).collect()
    # AW: all three there, each like its role, in the learnt group AW; W: nothing. The anchor is a known pair of a known channel.
    assert [tuple(r) for r in out] == [("m", "axi", None, 500, 500, 500, 1000, 575)]
    assert got(protocol.detect_by_score(protocol.score(s, channels, roles))) == [("m", "axi", 575)]
    variants = frame(spark, [("axi", "lite", ["awaddr"], ["awlen"]), ("axi", "full", ["awaddr", "awlen"], []), ("axi", "any", [], [])], "protocol string, variant string, needs array<string>, absent array<string>")
    overrides = frame(spark, [("axi", "lite", "W", ["awaddr"], 50, 50)], "protocol string, variant string, channel string, needs array<string>, name_score int, pattern_score int")
    r = protocol.score(s, channels, roles, variants, overrides).first()
    assert (r["variant"], r["name"], r["pattern"]) == ("lite", 750, 750)
    assert protocol.score(s.where("module = 'k'"), channels, roles).collect() == []


def test_roles_with_pairs(spark):
    s = frame(spark, [*AXI, ("m", "wlast", 1, "output", ""), ("m", "wdata", 64, "output", ""), ("m", "wstrb", 8, "output", "")], SIGNALS)
    pairs = frame(spark, [("m", a, b) for x, y in (("awvalid", "awready"), ("wlast", "wdata"), ("wstrb", "wdata")) for a, b in ((x, y), (y, x))], "module string, name string, other string")
    r = {x["name"]: x for x in classify.roles(s, pairs).collect()}
    assert (r["awvalid"]["valid"], r["awready"]["ready"], r["awaddr"]["data"], r["wdata"]["data"]) == (70, 50, 30, 50)
    assert [r[x]["role"] for x in ("awvalid", "awready", "wlast", "wdata", "wstrb", "awaddr")] == ["valid", "ready", "last", "data", "strb", "data"]


def test_patterns(spark):
    e = frame(spark, [("a", "s", "DRIVER", "", "Add"), ("s", "h", "DRIVER", "", "ArithmeticShiftRight"), ("x[3:0]", "t", "DRIVER", "", ""), ("t", "r", "DRIVER", "", "Add"), ("g", "c1", "DRIVER", "", "GreaterThan"), ("g", "c2", "DRIVER", "", "LessThan"), ("c1", "y", "DRIVER", "p", ""), ("c2", "y", "DRIVER", "q", ""), ("w", "y", "DRIVER", "", "")], "src string, dst string, kind string, condition string, assign_type string")
    g = PropertyGraph.of(frame(spark, [], "id string"), e)
    assert got(classify.rounding().match(g)) == [("s", "h"), ("t", "r")]
    assert got(classify.clamp().match(g)) == [("c1", "y"), ("c2", "y")]
    assert got(classify.matches(g, classify.default_rules())) == [("c1", "y", "SATURATION"), ("c2", "y", "SATURATION"), ("s", "h", "ROUNDING"), ("t", "r", "ROUNDING")]
    assert {(r["src"], r["dst"], r["rule"]) for r in classify.annotated(g, classify.default_rules()).collect()} >= {("w", "y", ""), ("s", "h", "ROUNDING")}


def test_coverage_and_assertions(spark):
    pairs = frame(spark, [("a", "b"), ("c", "d")], "a string, b string")
    points = frame(spark, [(x,) for x in "abcd"], "name string")
    crosses = frame(spark, [("b", "a"), ("c", "d")], "a string, b string")
    bins = frame(spark, [("c", "illegal_bins"), ("a", "bins")], "name string, kind string")
    assert got(coverage.missing_illegal(pairs, points, crosses, bins)) == [("a", "b")]
    assert got(coverage.gaps(pairs, points, crosses.where("a = 'b'"), bins)) == [("missing_cross", "c", "d"), ("missing_illegal_bins", "a", "b")]
    refs = frame(spark, [("x", "A1"), ("y", "P")], "signal string, target string")
    asserts = frame(spark, [("A1", "Q"), ("A2", "P")], "id string, property string")
    assert got(coverage.assertions_of(refs, asserts, "y")) == [("A2", "P")] and got(coverage.signals_of(refs, asserts, "A2")) == [("y",)] and got(coverage.signals_of(refs, asserts, "A1")) == [("x",)]


def test_deadlocks_and_control(spark):
    g = graph(spark, [("v", "r"), ("r", "s")])
    rules = frame(spark, [("R1", "no_combinational_loop"), ("R2", "response_after_request"), ("R3", "fifo")], "id string, kind string")
    found = protocol.deadlocks(g, rules, frame(spark, [("A", "v", "r")], "channel string, valid string, ready string"), frame(spark, [("q", "r")], "request string, response string"))
    assert got(found) == [("R1", "no_combinational_loop", "v", "r"), ("R2", "response_after_request", "q", "r")]
    b = frame(spark, [("b1", "if", False, ["en", "d"]), ("b2", "case", False, ["d"]), ("b3", "if", True, ["en"])], "id string, kind string, has_else boolean, variables array<string>")
    assert got(domains.unfinished(b, "if"), "id") == [("b1",)] and got(domains.unfinished(b, "case"), "id") == [("b2",)] and got(domains.steering(b, ["en"], ["d"]), "id") == [("b1",)]


def test_small_functions(spark):
    row = frame(spark, [("sig", 3, 0, ["$signed", "int"], "Add", "left")], "s string, m int, l int, c array<string>, op string, side string")
    assert row.select(S.operand(*map(F.col, ("s", "m", "l", "c", "op", "side")))).first()[0] == "int($signed(sig[3:0])) → op: Add (left)"
    assert row.select(S.operator_label(F.col("op"), F.col("m"), F.col("l"), F.col("c"))).first()[0] == "int $signed + [3:0]"
    assert row.select(S.qualified(F.col("s"), F.lit("top")), S.qualified(F.lit("top.x"), F.lit("top"))).first()[:] == ("top.sig", "top.x")
    assert row.select(S.credibility(F.lit(True), F.lit(True), F.lit(True)), S.credibility(F.lit(False), F.lit(False), F.lit(True))).first()[:] == (10, 2)
    assert row.select(S.condition_names(F.lit("state == READY && awvalid || x[3]"))).first()[0] == ["state", "awvalid", "x"]


def test_graph_of_changed_tables(spark, tmp_path):
    """A graph is made once for its files, and again when they change."""
    for t in ("region", "nation", "customer", "orders", "lineitem", "supplier", "part"):
        spark.read.parquet(f"{SF}/{t}.parquet").coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    a = tables.trade(spark, str(tmp_path))
    assert tables.trade(spark, str(tmp_path)) is a
    spark.read.parquet(f"{SF}/region.parquet").limit(2).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/region.parquet")
    b = tables.trade(spark, str(tmp_path))
    assert b is not a and a.vertices.where("kind = 'PORT_IN' and not is_clock").count() == 5 and b.vertices.where("kind = 'PORT_IN' and not is_clock").count() == 2
    assert os.path.isdir(SF) and oracle.TABLES and "scc" in QUERIES
