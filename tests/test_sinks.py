"""Configuration, decomposition and evidence, exports and drawings, on small graphs and files."""

import json

import pytest
from pyspark.sql import functions as F
from test_graph import got, graph

from lodestone.functions import scalars as S
from lodestone.graph import PropertyGraph
from lodestone.operators import classify, decompose, domains, protocol, reports, traverse
from lodestone.sources import config, export, render

PROTOCOL = """
protocol: TOY
channels:
  A:
    required: [{name: a_valid}, a_ready]
    optional: [a_data]
  D: {required: [d_valid, d_ready]}
signal_roles:
  a_valid: {channel: A, role: valid, width: 1}
variants:
  - name: LITE
    needs_signals: [a_valid]
    needs_absent_signals: [d_valid]
    channel_overrides: [{channel: D, required: [a_valid], name_score: 0.25}]
"""
SEMANTICS = """
protocol: {name}
channels: [{{name: A, direction: request, valid: a_valid, ready: a_ready, depends_on: [D]}}]
deadlock_rules: [{{id: {name}-1, kind: no_combinational_loop, channels: [A]}}]
forbidden_combinational_loops: ["valid -> ready"]
"""

needs_yaml = pytest.mark.skipif(config.yaml is None, reason="needs a YAML parser")


@needs_yaml
def test_patterns(spark, tmp_path):
    f = tmp_path / "classify.yaml"
    f.write_text("rules:\n  - {class: control, patterns: [zap]}\n  - {class: width_filter}\n")
    p = config.patterns(spark, str(f))
    assert p.control == ("zap",) and p.data == S.DATA_NAMES and p.source.endswith("classify.yaml")
    v = spark.createDataFrame([("x", "zap_it", 7), ("y", "valid", 7)], "id string, name string, width_msb int")
    g = PropertyGraph.of(v, graph(spark, []).edges)
    assert got(classify.nodes(g, p.control, p.data), "id", "class") == [("x", "CONTROL"), ("y", "DATA")]
    assert got(classify.nodes(g), "id", "class") == [("x", "DATA"), ("y", "CONTROL")]
    assert p.overridden(data=[]).data == () and p.overridden(data=[]).control == p.control
    f.write_text("- 1")
    with pytest.raises(ValueError):
        config.patterns(spark, str(f))


@needs_yaml
def test_normaliser(spark, tmp_path):
    (tmp_path / "base.yaml").write_text("strip_prefix: [s_]\nstrip_suffix: [_i]\nremove_infix: [_x_, _x_y_]\n")
    (tmp_path / "more.yaml").write_text("extra_strip_prefix: [m_]\nstrip_suffix: []\nremove_underscore: false\nunknown: 3\n")
    base, both = (config.normaliser(spark, str(tmp_path / "base.yaml")), config.normaliser(spark, str(tmp_path / "more.yaml"), str(tmp_path / "base.yaml")))
    names = spark.createDataFrame([("t.s_a_x_y_b_i",), ("m_s_q[3]",), ("s_",)], "n string")
    assert got(names.select(base.of(F.col("n")).alias("x"))) == [("ab",), ("msq",), ("s",)]
    assert got(names.select(both.of(F.col("n")).alias("x"))) == [("a_b",), ("q",), ("s_",)]
    assert got(names.select(config.Normaliser(take_last_dot=False, strip_array_index=False).of(F.col("n")).alias("x"))) == [("msq[3]",), ("s",), ("t.saxybi",)]


@needs_yaml
def test_protocols(spark, tmp_path):
    (tmp_path / "a.yaml").write_text(PROTOCOL)
    (tmp_path / "b.yaml").write_text("protocol: [unclosed")
    (tmp_path / "c.yaml").write_text("channels: {}")
    (tmp_path / "d.yaml").write_text("protocol: BAD\nchannels: {A: {optional: [x]}}")
    (tmp_path / "e.txt").write_text("no")
    p = config.protocols(spark, str(tmp_path))
    assert got(p.channels) == [("TOY", "A", "a_data", False), ("TOY", "A", "a_ready", True), ("TOY", "A", "a_valid", True), ("TOY", "D", "d_ready", True), ("TOY", "D", "d_valid", True)]
    assert got(p.roles) == [("TOY", "a_valid", "A", "valid", 1)] and got(p.variants, "variant", "needs", "absent") == [("LITE", ["a_valid"], ["d_valid"])]
    assert got(p.overrides, "channel", "needs", "score", "name_score", "pattern_score") == [("D", ["a_valid"], 50, 25, 50)]
    assert [r["path"].rsplit("/", 1)[-1] for r in p.errors.orderBy("path").collect()] == ["b.yaml", "c.yaml", "d.yaml"]
    have = spark.createDataFrame([("m", "avalid")], "module string, signal string")
    assert got(protocol.variant(have, p.variants), "variant") == [("LITE",)]


@needs_yaml
def test_semantics(spark, tmp_path):
    for name in ("ONE", "TWO"):
        (tmp_path / f"{name}.yaml").write_text(SEMANTICS.format(name=name))
    s = config.semantics(spark, str(tmp_path), "TWO")
    assert got(s.rules, "id", "kind", "severity", "channels") == [("TWO-1", "no_combinational_loop", "warning", ["A"])]
    assert got(s.channels, "channel", "valid", "depends_on") == [("A", "a_valid", ["D"])] and got(s.forbidden, "loop") == [("valid -> ready",)]
    assert config.semantics(spark, str(tmp_path)).protocols.count() == 2
    with pytest.raises(FileNotFoundError, match="ONE"):
        config.semantics(spark, str(tmp_path), "NO")


def made(spark, edges, vertices=()):
    """edges: (src, dst, condition, expression)."""
    e = spark.createDataFrame(edges, "src string, dst string, condition string, expression string")
    return PropertyGraph.of(spark.createDataFrame(list(vertices), "id string, kind string"), e)


def slow_atoms(rows, ports, root, depth):
    """Atoms by recursion, from the definition."""
    import re

    words = lambda s: re.findall(r"[A-Za-z_]\w*(?:\[\d+(?::\d+)?\])?", s)
    full = lambda a, near: a.split("[")[0] if "." not in near else near.rsplit(".", 1)[0] + "." + a.split("[")[0]
    out = {a for s, d, c, x in rows if d == root and c for a in words(c) + words(x)}

    def follow(v, d, seen):
        if v in seen or d >= depth or v in ports:
            return
        for s, t, _, x in rows:
            if t == v:
                for a in words(x):
                    out.add(a)
                    follow(full(a, s), d + 1, seen | {v})

    for a in list(out):
        follow(full(a, root), 1, frozenset())
    return out


@pytest.mark.parametrize("depth", [1, 2, 3, None])
def test_atoms(spark, depth):
    rows = [("t.a", "t.q", "en && go[1]", "a"), ("t.b", "t.a", "", "b[3:0]"), ("t.c", "t.b", "", "c"), ("t.a", "t.c", "", "a"), ("t.p", "t.en", "", "p"), ("t.deep", "t.p", "", "deep"), ("t.z", "t.w", "", "z"), ("u.x.k", "u.x.y", "k", "k")]
    g = made(spark, rows, [("t.p", "PORT_IN")])
    roots = spark.createDataFrame([("t.q",), ("t.w",), ("u.x.y",), ("t.q",), (None,)], "root string")
    found = decompose.atoms(g, roots, depth)
    want = slow_atoms([(s, d, "go[1]" if "&&" in c else c, x) for s, d, c, x in rows], {"t.p"}, "t.q", depth or 99)
    assert {r["atom"] for r in found.collect()} == want and {r["root"] for r in found.collect()} == {"t.q"}
    assert got(decompose.too_deep(roots)) == [("u.x.y",)]


def test_decompose(spark):
    g = made(spark, [("t.a", "t.q", "go[1]", "a"), ("t.b", "t.a", "", "b[3:0] + 4'b0011"), ("t.a", "t.r", "a", "a")])
    roots = spark.createDataFrame([("t.q",), ("t.r",)], "root string")
    assert got(decompose.decompose(g, roots), "root", "atom", "base", "msb", "lsb", "level") == [("t.q", "a", "a", None, None, 0), ("t.q", "b[3:0]", "b", 3, 0, 1), ("t.q", "go[1]", "go", 1, 1, 0), ("t.r", "a", "a", None, None, 0), ("t.r", "b[3:0]", "b", 3, 0, 1)]
    assert got(decompose.decompose(g, roots, 2).where("truncated"), "atom", "rank", "pre_cap") == [("a", 1, 3), ("go[1]", 2, 3)]
    assert got(decompose.merged(decompose.decompose(g, roots))) == [("a", 0, 2), ("b[3:0]", 1, 2), ("go[1]", 0, 1)]
    page = list(render.atoms_report(["t.q", "t.r"], decompose.decompose(g, roots), decompose.control_blocks(g, roots)))
    assert "covergroup cg_t_q_t_r @(posedge clk);" in page and "- `t.a` -> `t.q` if `go[1]`: `a`" in page
    none = made(spark, [])
    assert got(decompose.atoms(none, roots)) == [] and got(decompose.atoms(g, roots.limit(0))) == []


def test_evidence(spark):
    g = made(spark, [("t.b", "t.a", "go", ""), ("t.c", "t.b", "", "c"), ("t.d", "t.c", "", "")])
    text = spark.createDataFrame([("t.a", "always", "if (go) a <= b;"), ("t.a", "if", "else"), ("t.b", "assign", "x = c"), ("t.c", "assign", None), ("t.d", "assign", "")], "id string, kind string, text string")
    roots = spark.createDataFrame([("t.a", "t.a")], "root string, id string")
    cols = ("id", "level", "snippets", "matches_expression", "matches_name", "credibility", "verified")
    assert got(decompose.evidence_chain(g, roots, text), *cols) == [("t.a", 0, 2, True, True, 10, True), ("t.b", 1, 1, True, False, 6, True), ("t.c", 2, 0, False, False, 0, False), ("t.d", 3, 0, False, False, 0, False)]
    assert got(decompose.evidence_chain(g, roots, text, 1), "id") == [("t.a",), ("t.b",)]


def test_export(spark, tmp_path):
    g = graph(spark, [("t.a", "t.b"), ("t.clk", "t.b", "CLOCK", ""), ("t.a", "t.b", "DRIVER", "go")], [("t.b", "REG")])
    covered = spark.createDataFrame([("b", True, False)], "name string, has_sva boolean, has_cov boolean")
    n = export.view_nodes(g, spark.createDataFrame([("t.b", 2)], "id string, stage int"), covered, inputs=("t.a",))
    assert got(n, "id", "risk", "stage", "has_sva", "is_input", "is_critical") == [("t.a", "LOW", None, False, True, False), ("t.b", "LOW", 2, True, False, False), ("t.clk", "LOW", None, False, False, False)]
    assert export.view_edges(g).count() == 3 and export.view_edges(g, most=2).count() == 2
    assert got(export.view_edges(g, conditions=False).select("condition").distinct()) == [(None,)]
    rows = [json.loads(r["value"]) for r in export.json_lines(n).collect()]
    a = next(r for r in rows if r["id"] == "t.a")
    assert "stage" not in a and a["is_critical"] is False and a["score"] == 2
    lists = spark.createDataFrame([([], "", 0)], "l array<int>, s string, n int")
    assert export.json_lines(lists).first()["value"] == '{"n":0}'
    export.write_view(g, str(tmp_path / "v"))
    assert spark.read.json(str(tmp_path / "v/edges")).count() == 3 and spark.read.json(str(tmp_path / "v/meta")).first().asDict() == {"node_count": 3, "edge_count": 3}


def test_kept_results(spark, tmp_path):
    root = str(tmp_path / "cache")
    assert export.kept(spark, root, "k1") is None and got(export.kept_stats(spark, root)) == [(0, 0, 0)]
    export.keep(spark.range(3), root, "k1")
    export.keep(spark.range(5), root, "k1")
    assert export.kept(spark, root, "k1").count() == 5 and export.kept_stats(spark, root).first()["keys"] == 1
    assert export.forget(spark, root, "k1") and export.kept(spark, root, "k1") is None and export.forget(spark, root)
    for bad in ("", "..", "a/b"):
        with pytest.raises(ValueError):
            export.forget(spark, root, bad)


def test_drawings(spark):
    g = graph(spark, [("t.a", "t.b", "DRIVER", 'x"y'), ("t.clk", "t.b", "CLOCK", "")], [("t.b", "REG")])
    g = PropertyGraph(g.vertices.withColumn("is_clock", F.col("id") == "t.clk"), g.edges)
    plain = list(render.dot(g, "a graph"))
    assert plain[0] == 'digraph "a graph" {' and '  "t.a" -> "t.b" [label="x\\"y"];' in plain and any("lightblue" in x for x in plain)
    boxes = list(render.modules_dot(g))
    assert any("cluster_" in x and '"t"' in x for x in boxes) and not any("clk" in x for x in boxes)
    assert any("clk" in x for x in render.modules_dot(g, clocks=True))
    assert not any("t.clk" in x for x in render.classes_dot(g)) and any("gold" in x for x in render.classes_dot(g, clocks=True))
    assert sum("rank=same" in x for x in render.stages_dot(g, reports.layers(g))) == 2
    assert list(render.operators_dot(g))[-1] == "}"
    assert len(list(render.dot(g, max_edges=1))) == 6
    empty = graph(spark, [], [("only", "REG")])
    assert any('"only"' in x for x in render.dot(empty)) and list(render.dot(graph(spark, []))) == ['digraph "graph" {', "  rankdir=LR;", "}"]
    assert list(render.graph_mermaid(g))[:2] == ["graph TD", '    n0["a"]'] and '    n0 -->|"x#quot;y"| n1' in list(render.graph_mermaid(g))
    page = render.html(PropertyGraph(g.vertices, g.edges.withColumn("condition", F.lit("</script>"))), "a<b")
    assert "a&lt;b" in page and page.count("</script>") == 1
    states = spark.createDataFrame([("IDLE", "RUN", "go"), ("RUN", "IDLE", "")], "from_state string, to_state string, condition string")
    fsm = list(render.states_dot(states, "m", "IDLE"))
    assert '  "IDLE" [style=filled, color=lightgray];' in fsm and '  "RUN" -> "IDLE" [label="1"];' in fsm
    assert "    IDLE --> RUN: go" in list(render.mermaid(states))
    assert render.drawn(plain, "/tmp/never.png", engine="no-such-program") == 127
    assert render.failure("E_X", "no", hint="h") == {"ok": False, "command": None, "error": "no", "error_code": "E_X", "errors": ["no"], "hint": "h"}


def test_trees(spark):
    assert list(render.tree({"a": ["b", "c"], "b": ["a"], "c": ["d"]}, "a", {"d": "[HIGH]"})) == ["a", "├── b", "│   └── a", "└── c", "    └── d  [HIGH]"]
    g = graph(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a")])
    found = traverse.fan_out(g, traverse.roots(spark, ["a"]))
    assert list(render.reach_tree(g, found, "a")) == ["a", "├── b", "│   └── d", "└── c"]


def test_other_tables(spark):
    calls = spark.createDataFrame([("1", None, "body", "call", "sequence", None), ("2", "1", "", "fork", "generic", "join_any"), ("3", "2", "req", "randomize", "generic", "x > 1")], "id string, parent string, callee string, kind string, pattern string, detail string")
    assert list(render.calls_mermaid(calls)) == ["graph TD", '    n0["[SEQUENCE] body"]', '    n1["[FORK/join_any]"]', '    n2["[RANDOMIZE] req<br/>x > 1"]', "    n0 --> n1", "    n1 --> n2"]
    a = spark.createDataFrame([("m.a0", "assert", "m.p", "late"), ("m.a1", "cover", "", "")], "id string, kind string, property string, message string")
    p = spark.createDataFrame([("m.p", "p")], "id string, name string")
    assert '  "m.a0" -> "m.p";' in list(render.assertions_dot(a, p))
    parts = spark.createDataFrame([("env", "my_env", "uvm_env", "env", ""), ("drv", "my_drv", "uvm_driver", "driver", "env")], "name string, class string, base string, type string, parent string")
    links = spark.createDataFrame([("env.x.port", "drv.exp")], "source string, target string")
    lines = list(render.testbench_dot(parts, links))
    assert '  "env" -> "drv" [label="contains", style=solid];' in lines and '  "env" -> "drv" [label="port → exp", style=dashed];' in lines
    assert domains.state_machine(graph(spark, [])).count() == 0
