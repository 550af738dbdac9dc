"""Risks, impact, versions and random variables on small tables, against plain Python where there is a search."""

from __future__ import annotations

import random

from lodestone.graph import PropertyGraph
from lodestone.operators import diff, impact, machines, paths, randomize, stats, timing, traverse
from lodestone.sources import snapshots

EDGES = "src string, dst string, kind string, condition string, assign_type string"


def got(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def pipeline(spark):
    """in → r1 ⇄ r2 → w → x → r3, of which w and x are logic; r4 is reached by a clock only."""
    kinds = {"t.in": "PORT_IN", "t.clk": "PORT_IN", "t.r1": "REG", "t.r2": "REG", "t.w": "WIRE", "t.x": "WIRE", "t.r3": "REG", "t.r4": "REG"}
    v = frame(spark, list(kinds.items()), "id string, kind string")
    e = [("t.in", "t.r1"), ("t.r1", "t.r2"), ("t.r2", "t.r1"), ("t.r2", "t.w"), ("t.w", "t.x"), ("t.x", "t.r3")]
    rows = [(a, b, "DRIVER", "", "") for a, b in e] + [("t.clk", "t.r4", "CLOCK", "", "")]
    return PropertyGraph.of(v, frame(spark, rows, EDGES))


def test_risk_and_report(spark):
    g = pipeline(spark)
    depths = timing.register_depths(g, timing.data_graph(g))
    risk = {r["id"]: (r["depth"], r["score"], r["risk"]) for r in timing.vertex_risk(g, depths).collect()}
    assert risk["t.r3"] == (3, 45, "HIGH") and risk["t.r1"] == (1, 25, "MEDIUM") and risk["t.x"] == (2, 20, "MEDIUM") and risk["t.r4"] == (0, 15, "LOW") and len(risk) == 8
    paths = timing.register_paths(g, depths, 10)
    # r3 lies behind three registers and one step of logic, r2 behind two, r1 behind one.
    assert got(timing.report(paths)) == [(3, 3, 20, 0, 1, 1, 1)]
    assert got(timing.risk_ranking(paths, 2), "rank", "target", "violation") == [(1, "t.r3", "MEDIUM"), (2, "t.r2", "LOW")]
    assert got(timing.report(paths.where("false"))) == [(0, 0, 0, 0, 0, 0, 0)]


def test_ranking_puts_violations_first(spark):
    rows = [("a", 9, 3, "HIGH", "LOW"), ("b", 5, 2, "LOW", "HIGH"), ("c", 9, 3, "HIGH", "MEDIUM"), ("d", 7, 2, "LOW", "HIGH")]
    paths = frame(spark, rows, "target string, score bigint, depth bigint, risk string, violation string")
    assert [r["target"] for r in timing.risk_ranking(paths, 3).orderBy("rank").collect()] == ["d", "b", "a"]


def test_declared_depths(spark):
    g = pipeline(spark)
    props = frame(spark, [("P", ["|=>", "##1"], ["r3", "w", "none", "r3"]), ("Q", ["|->"], ["r4"]), ("R", None, ["in"]), ("E", ["|=>"], [])], "property string, operators array<string>, signals array<string>")
    found = timing.declared_depths(g, props, timing.register_depths(g, timing.data_graph(g)))
    assert got(found) == [("P", "|=>", 1, "r3", "t.r3", 3), ("P", "|=>", 1, "w", "t.w", 2), ("Q", "|->", 0, "r4", "t.r4", 0), ("R", "|->", 0, "in", "t.in", 0)]
    deep = PropertyGraph.of(frame(spark, [("a.u.q",), ("b.q",), ("q",)], "id string"), frame(spark, [], EDGES))
    none = frame(spark, [], "id string, depth bigint")
    props = frame(spark, [("P", ["|->"], ["q", "u.q"])], "property string, operators array<string>, signals array<string>")
    assert got(timing.declared_depths(deep, props, none), "signal", "id") == [("q", "a.u.q"), ("u.q", "a.u.q")]


def test_impact_paths(spark):
    rows = [("t.s", "t.a", "DRIVER", "en", ""), ("t.s", "t.b", "DRIVER", "en", "nonblocking"), ("t.s", "t.c", "DRIVER", "", ""), ("t.c", "t.clk_o", "DRIVER", "", "")]
    rows += [("t.a", f"t.l{i}", "DRIVER", "", "") for i in range(12)] + [("t.clk_o", f"t.k{i}", "DRIVER", "", "") for i in range(51)] + [("t.b", "t.z", "CONNECTION", "", "")]
    g = PropertyGraph.of(frame(spark, [], "id string"), frame(spark, rows, EDGES))
    loads = traverse.fan_out(g, traverse.roots(spark, ["t.s"]), 2)
    covered = frame(spark, [("t.b", True, False), ("t.b", False, True), ("t.c", False, True)], "id string, has_sva boolean, has_cov boolean")
    found = {r["id"]: r for r in impact.paths(g, loads, covered, 30).collect()}
    cells = lambda x: tuple(found[x][c] for c in ("path_type", "fanout", "has_sva", "has_cov", "score", "risk", "advice"))
    # 10 for two ends, 2 for each of the fan-out and 15 for a large one, 20 without coverage, 10 for a condition
    assert cells("t.a") == ("conditional", 12, False, False, 10 + 24 + 15 + 20 + 10, "HIGH", "cover this path; buffer a fan-out of 12")
    assert cells("t.b") == ("clocked", 0, True, True, 20, "MEDIUM", "")  # a connection is no fan-out
    assert cells("t.c") == ("combinational", 1, False, True, 12, "LOW", "")
    assert cells("t.clk_o")[-1] == "cover this path; buffer a fan-out of 51; divide the clock or reset"
    whole = {r["id"]: r for r in impact.paths(g, loads, covered, 30, by_level=True).collect()}
    assert whole["t.l0"]["score"] == found["t.l0"]["score"] + 5 and whole["t.l0"]["advice"] == "cover this path; check between its ends"
    assert got(impact.summary(impact.paths(g, loads, covered, 30))) == [("t.s", 17, 15, 1, 1, 15, 10 + 102 + 15 + 20, 1)]


def plain_reach(edges, starts):
    seen, now, rounds = set(), set(starts), 0
    while now:
        new = {b for a, b in edges if a in now} - seen
        seen |= new
        now, rounds = new, rounds + 1
    return seen, rounds


def test_compare_against_plain(spark):
    for seed in range(3):
        r = random.Random(seed)
        some = lambda: {(f"q{r.randrange(14)}", f"q{r.randrange(14)}") for _ in range(18)}
        base = some()
        old, new = base | set(list(some())[:2]), base | set(list(some())[:2])
        ids_old, ids_new = [f"q{i}" for i in range(13)], [f"q{i}" for i in range(1, 14)]
        graph = lambda ids, es: PropertyGraph.of(frame(spark, [(i, "REG" if i == "q3" and ids is ids_new else "WIRE") for i in ids], "id string, kind string"), frame(spark, [(a, b, "DRIVER", "", "") for a, b in es if a in ids and b in ids], EDGES))
        a, b = graph(ids_old, old), graph(ids_new, new)
        ea, eb = {e for e in old if set(e) <= set(ids_old)}, {e for e in new if set(e) <= set(ids_new)}
        changed = {"q0", "q13", "q3"}
        (fa, ra), (fb, rb) = plain_reach(ea, changed & set(ids_old)), plain_reach(eb, changed & set(ids_new))
        row = diff.compare(a, b).collect()[0]
        assert (row["added"], row["removed"], row["modified"], row["identical"]) == (1, 1, 1, False)
        assert (row["pairs_added"], row["pairs_removed"]) == (len(eb - ea), len(ea - eb))
        assert (row["newly"], row["no_longer"], row["still"], row["depth_old"], row["depth_new"]) == (len(fb - fa), len(fa - fb), len(fa & fb), ra, rb)
        touched = {x for e in ea ^ eb for x in e}
        assert row["stable"] == len((set(ids_old) & set(ids_new)) - touched)


def test_compare_warns_and_tags(spark, tmp_path):
    ids = [f"n{i:02}" for i in range(40)]
    chain = [(a, b, "DRIVER", "", "") for a, b in zip(ids, ids[1:])]
    v = frame(spark, [(i,) for i in ids], "id string")
    a = PropertyGraph.of(v, frame(spark, chain, EDGES))
    b = PropertyGraph.of(v, frame(spark, chain[::2], EDGES))
    snapshots.save(a, str(tmp_path), "one")
    snapshots.save(b, str(tmp_path), "two")
    row = snapshots.compare(spark, str(tmp_path), "one", "two").collect()[0]
    # No vertex changed, but all of them but the first and the last lost a pair.
    assert (row["stable"], row["health_old"], row["unstable"], row["coupling"], row["depth_old"]) == (2, 500, 9500, "critical", 0)
    same = snapshots.compare(spark, str(tmp_path), "one", "one").collect()[0]
    assert same["identical"] and same["health_new"] == 10000 and same["coupling"] == "low"
    empty = PropertyGraph.of(frame(spark, [], "id string"), frame(spark, [], EDGES))
    row = diff.compare(empty, empty).collect()[0]
    assert row["identical"] and row["health_old"] == 0 and row["coupling"] == "low" and row["still"] == 0


def test_random_reachability(spark):
    v = frame(spark, [("c", "addr", "rand"), ("c", "addr", "rand"), ("c", "len", "randc"), ("d", "x", "rand"), ("d", "a_very_long_name", "rand")], "class string, name string, kind string")
    calls = frame(spark, [("randomize", None), (randomize.WITH, "addr2 > 3 && addr < 9"), (randomize.WITH, "addr2 > 3 && addr < 9"), (randomize.WITH, "length == 4"), (randomize.WITH, None), (None, "len")], "kind string, inline string")
    refs = frame(spark, [("addr", "decl"), ("len", "assign"), ("len", "always"), ("addr", None)], "name string, kind string")
    points = frame(spark, [("g", "x"), ("h", "x")], "covergroup string, signal string")
    found = randomize.reachability(v, calls, refs, points)
    inline = [i for k, i in ((r["kind"], r["inline"]) for r in calls.collect()) if k == randomize.WITH and i]
    want = {n: 2 + sum(n in i for i in inline) for n in ("addr", "len", "x", "a_very_long_name")}
    assert got(found) == [("c", "addr", "rand", "dead", want["addr"], 0, 0), ("c", "len", "randc", "alive", want["len"], 2, 0), ("d", "a_very_long_name", "rand", "dead", 2, 0, 0), ("d", "x", "rand", "alive", 2, 0, 2)]
    assert got(randomize.totals(found)) == [("c", 2, 1, 1), ("d", 2, 1, 1)]
    assert randomize.reachability(v.where("false"), calls, refs, points).collect() == []
    assert got(randomize.reachability(v.where("class = 'd'"), calls.where("false"), refs, points), "name", "randomized") == [("a_very_long_name", 0), ("x", 0)]


def test_parallel_segments(spark):
    rows = [("a", "b", "DRIVER", "state == S1 && go", ""), ("a", "b", "DRIVER", "en", "nonblocking"), ("a", "b", "DRIVER", "rst_n", ""), ("u.p", "b", "CONNECTION", "", ""), ("in.p", "in.q", "DRIVER", "rst_n && k", "")]
    g = PropertyGraph.of(frame(spark, [], "id string"), frame(spark, rows, EDGES))
    pairs = frame(spark, [("a", "b"), ("a", "b"), ("b", "a"), ("u.p", "b"), ("u.p", "x.q")], "src string, dst string")
    found = got(paths.parallel_segments(g, pairs), "src", "dst", "pos", "condition", "effective_condition")
    # A reset alone comes first, then the shorter condition.
    assert found == [("a", "b", 0, "rst_n", "rst_n"), ("a", "b", 1, "en", "en"), ("a", "b", 2, "state == S1 && go", "go"), ("u.p", "b", 0, "", "")]
    inside = frame(spark, [("u.p", "in.p"), ("u.p", "z"), ("x.q", "in.q")], "id string, internal string")
    found = got(paths.parallel_segments(g, pairs.where("src = 'u.p'"), inside), "src", "dst", "pos", "condition", "effective_condition")
    assert found == [("u.p", "b", 0, "", ""), ("u.p", "x.q", 0, "rst_n && k", "k")]  # u.p to b is there only as it stands


def test_stage_breakdown(spark):
    g = pipeline(spark)
    stages = frame(spark, [("t.r1", 1), ("t.r2", 2)], "id string, stage bigint")
    p = frame(spark, [(["t.in", "t.r1", "t.r2", "t.w"],)], "path array<string>")
    found = got(paths.stage_breakdown(p, g, stages).drop("path"))
    assert found == [(0, "t.in", "t.r1", None, 1, "PORT_IN", "REG", True), (1, "t.r1", "t.r2", 1, 2, "REG", "REG", True), (2, "t.r2", "t.w", 2, None, "REG", "WIRE", False)]


def test_fanout_loads_and_nets(spark):
    v = frame(spark, [("clk", True, False), ("rst", False, True), ("a", False, False)], "id string, is_clock boolean, is_reset boolean")
    rows = [("clk", "x", "DRIVER", "", ""), ("clk", "x", "DRIVER", "en", ""), ("clk", "y", "DRIVER", "", ""), ("rst", "y", "DRIVER", "", ""), ("rst", "z", "RESET", "", ""), ("a", "b", "DRIVER", "", "")]
    g = PropertyGraph.of(v, frame(spark, rows, EDGES))
    assert got(stats.fanout_loads(g)) == [("a", 1, "b"), ("clk", 1, "x"), ("clk", 2, "y"), ("rst", 1, "y")]
    assert got(stats.net_fanouts(g)) == [(2, 1)] and got(stats.net_fanouts(g, "CLOCK")) == [(0, 0)]


def test_state_machines(spark):
    rows = [("m.IDLE", "m.state", "DRIVER", "!rst_n", ""), ("m.REQ", "m.state", "DRIVER", "!!rst_n && state == IDLE && go", ""), ("m.IDLE", "m.state", "DRIVER", "state === REQ", "")]
    rows += [("m.DONE", "m.state", "DRIVER", "", ""), ("clk", "m.state", "CLOCK", "", ""), ("B", "state", "DRIVER", "state == A", ""), ("C", "n.state", "DRIVER", "!rst_n || x", ""), ("q", "m.substate", "DRIVER", "", "")]
    found = machines.moves(PropertyGraph.of(frame(spark, [], "id string"), frame(spark, rows, EDGES))).cache()
    # A term taken from between two others leaves both of its signs, as the scalar function has it.
    assert got(machines.transitions(found)) == [("m.state", "IDLE", "REQ", "!!rst_n && && go"), ("m.state", "REQ", "IDLE", "1"), ("state", "A", "B", "1")]
    assert got(machines.states(found).where("is_reset"), "signal", "state") == [("m.state", "IDLE"), ("n.state", "C"), ("state", "A")]
    assert got(machines.summary(found)) == [("m.state", "m", 3, 2, "IDLE"), ("n.state", "n", 1, 0, "C"), ("state", "", 2, 1, "A")]
    g = PropertyGraph.of(frame(spark, [], "id string"), frame(spark, rows, EDGES))
    assert {r["signal"] for r in machines.moves(g, module="m").collect()} == {"m.state"} and machines.moves(g, "other").collect() == []


def test_case_machines(spark):
    nodes = [("c2", "CONDITION", ["s"], "case (s2)", ""), ("c1", "CONDITION", ["s", "t"], "case (s1)", ""), ("x", "STATEMENT", ["s"], "", "IDLE"), ("y", "STATEMENT", None, "", "REQ"), ("z", "STATEMENT", [], "", None)]
    n = frame(spark, nodes, "id string, kind string, variables array<string>, expression string, state_value string")
    e = frame(spark, [("c1", "x", "CASE_MATCH", "0"), ("c1", "y", "CASE_MATCH", None), ("c1", "z", "CASE_MATCH", "2"), ("c1", "y", "SEQUENCE", "3"), ("c2", "y", "CASE_MATCH", "4")], "src string, dst string, kind string, condition string")
    want = [(v, "case (s1)", to, c) for v in ("s", "t") for to, c in (("IDLE", "0"), ("REQ", ""))]
    assert got(machines.of_cases(n, e)) == want
