"""Register depth, conditions of statements and searches between sets, against plain Python on small graphs with cycles."""

from __future__ import annotations

import random
from collections import deque

import pytest
import test_graph

from lodestone import storage
from lodestone.operators import elaborate, search, statements, timing, traverse


def got(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def ids(spark, *names):
    return spark.createDataFrame([(x,) for x in names], "id string")


def looped(seed=2, n=30, m=70):
    r = random.Random(seed)
    return sorted({(f"q{r.randrange(n):02}", f"q{r.randrange(n):02}") for _ in range(m)})


def plain_visits(edges, starts, regs):
    out, now, hops = {s: (0, None, 0) for s in starts}, set(starts), 0
    while now:
        hops += 1
        new = {}
        for a, b in sorted(edges):
            if a in now and b not in out and b not in new:
                new[b] = (hops, a, out[a][2] + (b in regs))
        out |= new
        now = set(new)
    return out


def test_first_visits_with_cycles(spark):
    edges, regs = looped(), {f"q{i:02}" for i in range(0, 30, 3)}
    g = test_graph.graph(spark, edges)
    w = spark.createDataFrame([(x, 1) for x in regs], "id string, w int")
    found = {r[0]: tuple(r)[1:] for r in timing.first_visits(g.edges, ids(spark, "q00", "q05"), w).collect()}
    assert found == plain_visits(edges, ["q00", "q05"], regs)


def test_register_paths_in_a_loop(spark):
    edges = [("in", "r1"), ("r1", "r2"), ("r2", "r1"), ("r2", "w"), ("w", "x"), ("x", "r3"), ("clk", "r1")]
    kinds = [("in", "PORT_IN"), ("clk", "PORT_IN"), ("r1", "REG"), ("r2", "REG"), ("r3", "REG"), ("w", "WIRE"), ("x", "SIGNAL")]
    g = test_graph.graph(spark, edges, kinds)
    depths = timing.register_depths(g, timing.data_graph(g))
    assert got(depths, "id", "depth") == [("in", 0), ("r1", 1), ("r2", 2), ("r3", 3), ("w", 2), ("x", 2)]
    paths = {r["target"]: r.asDict() for r in timing.register_paths(g, depths, 2).collect()}
    assert set(paths) == {"r3", "r2"}
    assert paths["r3"]["path"] == "in>r1>r2>w>x>r3" and paths["r3"]["registers"] == "r1>r2>r3" and paths["r3"]["score"] == 6
    assert (paths["r3"]["cycles"], paths["r3"]["combinational"], paths["r3"]["risk"], paths["r3"]["violation"]) == (3, 1, "HIGH", "MEDIUM")
    assert got(timing.register_graph(g)) == sorted(x for x in edges if x != ("w", "x"))


def test_longest_over_cycles(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("a", "d"), ("d", "e"), ("z", "e"), ("e", "f")]
    found = timing.longest_over_cycles(test_graph.graph(spark, edges).edges, ids(spark, "a"))
    assert got(found) == [("a", 0, None), ("b", 1, "a"), ("d", 2, "b"), ("e", 3, "d"), ("f", 4, "e")]


def plain_conditions(rows):
    kids, by, out = {}, {r[0]: r for r in rows}, {}
    for r in rows:
        kids.setdefault(r[1], []).append(r)
    word = lambda c: c.replace("_", "a").isalnum()
    real = lambda c: bool(c) and not any(x in c for x in ("posedge", "negedge", "or "))

    def walk(row, path):
        out[row[0]] = " && ".join(path)
        _, _, _, kind, cond = row
        below = sorted(kids.get(row[0], []), key=lambda r: (r[2], r[0]))
        cond, elder = cond or "", []
        for i, k in enumerate(below):
            c = k[4] or ""
            if kind == "if":
                walk(k, path + elder + ([c] if real(c) else []))
                elder = elder + ([f"!{c}" if word(c) else f"!({c})"] if real(c) else [])
            elif kind == "case":
                walk(k, [*path, f"{cond} == {c or 'default'}" if cond else c or "default"])
            elif kind == "choice":
                walk(k, [*path, cond if i == 0 else f"!({cond})"])
            else:
                walk(k, path)

    for r in rows:
        if r[1] is None:
            walk(r, [])
    return sorted(out.items()) if by else []


def test_path_conditions(spark):
    rows = [
        ("t", None, 0, "block", None), ("i", "t", 1, "if", ""), ("b1", "i", 1, "branch", "en"), ("b2", "i", 2, "branch", "a == b"), ("b3", "i", 3, "branch", ""),
        ("x1", "b1", 0, "assign", ""), ("c", "b2", 0, "case", "state"), ("k1", "c", 0, "item", "IDLE || DONE"), ("k2", "c", 1, "item", None), ("x2", "k1", 0, "assign", ""),
        ("h", "k2", 0, "choice", "g"), ("v0", "h", 0, "assign", ""), ("v1", "h", 1, "choice", "p & q"), ("v2", "v1", 0, "assign", ""), ("v3", "v1", 1, "assign", ""),
        ("l", "b3", 0, "loop", ""), ("j", "l", 0, "if", ""), ("e1", "j", 0, "branch", "posedge clk"), ("e2", "j", 1, "branch", "rst"), ("x3", "e2", 9, "assign", ""), ("s", None, 1, "assign", None), ("lost", "nowhere", 0, "assign", ""),
    ]
    found = statements.path_conditions(spark.createDataFrame(rows, "id string, parent string, position int, kind string, condition string"))
    assert got(found, "id", "condition") == plain_conditions(rows)
    assert dict(got(found, "id", "condition"))["v3"] == "!en && a == b && state == default && !(g) && !(p & q)"
    assert got(statements.path_conditions(found.selectExpr("id", "id as parent", "1 as position", "kind", "condition").limit(0))) == []


def nearest(edges, a):
    out, todo = {a: [a]}, deque([a])
    while todo:
        level, todo_next, new = list(todo), deque(), {}
        for x in sorted(level):
            for s, d in sorted(edges):
                if s == x and d not in out and d not in new:
                    new[d] = out[x] + [d]
        out |= new
        todo_next.extend(new)
        todo = todo_next
    return out


def test_shortest_paths_of_many_pairs(spark):
    edges, starts, ends = looped(4), ["q01", "q02", "q09"], ["q09", "q11", "q20", "nowhere"]
    found = search.shortest_paths(test_graph.graph(spark, edges).edges, ids(spark, *starts), ids(spark, *ends))
    want = sorted(((a, b, i, x) for a in starts for b, path in nearest(edges, a).items() if b in ends and b != a for i, x in enumerate(path)), key=str)
    assert got(found) == want and want


def plain_chain(paths, most):
    taken = set()
    order = sorted(paths, key=lambda p: (-len(p), p[0], p[-1]))
    for p in order:
        e = set(zip(p, p[1:], strict=False))
        if taken and len(taken) + len(e) > most:
            continue
        taken |= e
        if len(taken) >= most:
            break
    if len(taken) < most:
        for p in order:
            new = set(zip(p, p[1:], strict=False)) - taken
            if not new:
                continue
            if len(taken) + len(new) > most:
                break
            taken |= new
    return sorted(taken)


@pytest.mark.parametrize("most", [1, 7, 12, 100])
def test_chain_under_a_budget(spark, most):
    edges = looped(4)
    paths = [p for a in ("q01", "q02", "q07") for b, p in nearest(edges, a).items() if b in ("q09", "q11", "q20", "q15") and b != a]
    rows = [(p[0], p[-1], i, x) for p in paths for i, x in enumerate(p)]
    found = search.chain(spark.createDataFrame(rows, "src string, dst string, pos bigint, id string"), most)
    assert got(found, "src", "dst") == plain_chain(paths, most)


def plain_paths(edges, a, b, most=None):
    out = []

    def walk(path):
        if path[-1] == b:
            out.append(tuple(path))
            return
        if most is None or len(path) <= most:
            for s, d in edges:
                if s == path[-1] and d not in path:
                    walk([*path, d])

    walk([a])
    return sorted(out)


def test_all_paths(spark):
    edges = looped(6, 12, 26)
    g = test_graph.graph(spark, edges)
    for most in (None, 4):
        assert sorted(tuple(r[0]) for r in search.all_paths(g.edges, "q00", "q07", most).collect()) == plain_paths(edges, "q00", "q07", most)
    layers = [(f"a{i}{x}", f"a{i + 1}{y}") for i in range(14) for x in range(4) for y in range(4)]
    assert search.all_paths(test_graph.graph(spark, [*layers, ("elsewhere", "z")]).edges, "a00", "z").collect() == []  # no path, no work


def test_signal_paths_by_candidates(spark):
    g = test_graph.graph(spark, [("d[3:0]", "d", "BIT_SELECT", ""), ("d[3:0]", "m"), ("m", "q"), ("q[1]", "q", "BIT_SELECT", ""), ("q", "w")])
    assert got(search.signal_paths(g, "d", "q[1]")) == [("d[3:0]", "q", ["d[3:0]", "m", "q"])]
    assert got(search.signal_paths(g, "w", "d")) == []


def test_drivers_by_rules(spark):
    edges = [("a", "y"), ("1'b0", "a"), ("y", "y"), ("t.u.q", "z", "CONNECTION", ""), ("k", "t.u.d"), ("t.in", "z", "CONNECTION", ""), ("n", "t.in2", "CONNECTION", ""), ("t.in2", "z", "CONNECTION", ""), ("s", "z", "CONNECTION", ""), ("h", "s"), ("r", "z", "CONNECTION", ""), ("e", "r"), ("ck", "z", "CLOCK", ""), ("osc", "ck")]
    kinds = [("t.u.q", "PORT_OUT"), ("t.u.d", "PORT_IN"), ("t.in", "PORT_IN"), ("t.in2", "PORT_IN"), ("s", "SIGNAL"), ("r", "REG"), ("1'b0", "CONST"), ("def.o", "PORT_OUT"), ("i1.o", "PORT_OUT"), ("w", "WIRE")]
    g = test_graph.graph(spark, [*edges, ("w", "i1.o")], kinds)
    ports = spark.createDataFrame([("i1.o", "def.o")], "inst_port string, def_port string")
    found = search.drivers(search.driver_rules(g, ports), traverse.roots(spark, ["y", "z", "def.o"]))
    assert got(found) == [("def.o", "w"), ("y", "1'b0"), ("y", "a"), ("y", "y"), ("z", "e"), ("z", "k"), ("z", "osc"), ("z", "s"), ("z", "t.in"), ("z", "t.u.q")]
    assert got(search.drivers(search.driver_rules(g), traverse.roots(spark, ["y"]), 1)) == [("y", "a"), ("y", "y")]


def test_storage_keeps_empty_and_null_values(spark):
    df = spark.createDataFrame([("", 1), (None, 2), ("A/B=c", 3)], "kind string, n int")
    assert got(storage.stored(df, by="kind", order="n")) == got(df)
    g = test_graph.graph(spark, [("a", "b", "", ""), ("b", "c", "CLOCK", "")]).materialised()
    assert got(g.edges.where("kind != 'CLOCK'"), "src", "kind") == [("a", "")]


def test_a_level_joins_bucketed_steps_without_shuffling_them(spark):
    steps = storage.bucketed(spark.range(1000).selectExpr("cast(id as string) as at", "cast(id + 1 as string) as next"), "at")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        step = spark.range(10).selectExpr("cast(id as string) as at").join(steps, "at")
        plan = step._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1, plan
        assert step.count() == 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_segments_merge(spark):
    parts = storage.Segments(spark.range(1), 1)
    for i in range(1, 30):
        parts.add(spark.range(i, i + 1), 1)
    assert len(parts.parts) <= storage.Segments.MOST and sorted(r[0] for r in parts.table().collect()) == list(range(30))


def test_concatenations(spark):
    rows = [("x", "lhs", 0, "a", 4), ("x", "lhs", 1, "b", 0), ("x", "lhs", 2, "c", 3), ("x", "rhs", 0, "p", 2), ("x", "rhs", 1, "q", 4), ("y", "lhs", 0, "a", 1), ("z", "rhs", 0, "a", 1), ("w", "lhs", 0, "s", 8), ("w", "rhs", 0, "s", 8)]
    found = elaborate.concatenations(spark.createDataFrame(rows, "assign string, side string, position int, name string, width int"))
    bits = {(a, d, i): (s, j) for a, s, d, sm, sl, dm, dl in map(tuple, found.collect()) for i, j in zip(range(dl, dm + 1), range(sl, sm + 1), strict=True)}
    lay = lambda side, a: [(n, i) for x, s, _, n, w in reversed(rows) if x == a and s == side for i in range(w)]
    want = {(a, *d): s for a in "xyzw" for d, s in zip(lay("lhs", a), lay("rhs", a), strict=False)}
    assert bits == want and found.count() == 4


def test_inherited_and_copied_constraints(spark):
    classes = spark.createDataFrame([("kid", "mid"), ("mid", "top"), ("other", "top"), ("x", "y"), ("y", "x")], "id string, parent string")
    constraints = spark.createDataFrame([("top", "a", "t.a"), ("top", "b", "t.b"), ("mid", "a", "m.a"), ("mid", "a", "m.z"), ("kid", "c", "k.c"), ("y", "q", "y.q")], "class string, name string, id string")
    held = elaborate.inherited(classes, constraints)
    assert got(held, "class", "id", "level") == [("kid", "k.c", 0), ("kid", "m.a", 1), ("kid", "t.b", 2), ("mid", "m.a", 0), ("mid", "t.b", 1), ("other", "t.a", 1), ("other", "t.b", 1), ("top", "t.a", 0), ("top", "t.b", 0), ("x", "y.q", 1), ("y", "y.q", 0)]
    nodes = spark.createDataFrame([("m.a", None, 1), ("n1", "m.a", 2), ("n2", "n1", 3), ("t.b", None, 4), ("k.c", None, 5), ("n3", "k.c", 6)], "id string, parent string, v int")
    assert got(elaborate.copied(held, nodes).where("class = 'kid'"), "id", "parent", "of", "v") == [("kid::m.a", None, "m.a", 1), ("kid::n1", "kid::m.a", "n1", 2), ("kid::n2", "kid::n1", "n2", 3), ("kid::t.b", None, "t.b", 4)]
