"""Inlining against plain Python, and schedules of operators on small graphs."""

from __future__ import annotations

import random
import re

import test_graph
from pyspark.sql import functions as F

from lodestone.functions.scalars import KEYWORDS
from lodestone.operators import inline, timing

CALLS = "owner string, call string, callee string, condition string"
BINDINGS = "owner string, call string, formal string, actual string"
EDGES = "owner string, src string, dst string, condition string"


def plain(calls, bindings, edges):
    """By recursion: every name of a body is looked up once."""
    name = re.compile(r"[A-Za-z_]\w*")

    def text(t, names, instance, whole=False):
        if not instance:
            return t

        def one(m):
            w = m.group()
            if w in KEYWORDS:
                return w
            if w in names:
                return f"({names[w]})" if whole and not re.fullmatch(r"[\w.]+", names[w]) else names[w]
            return f"{instance}.{w}"

        return name.sub(one, t)

    out = set()

    def go(function, instance, names, within, condition, level):
        join = lambda own: " && ".join(x for x in (condition, text(own or "", names, instance, True)) if x)
        for o, s, d, c in edges:
            if o == function:
                s = text(s, names, instance)
                for x in re.findall(r"[A-Za-z_][\w.]*", s) or [s]:
                    out.add((instance, function, level, x, text(d, names, instance), join(c)))
        for o, call, callee, c in calls:
            if o == function and callee not in within:
                inner = {f: text(a, names, instance) for oo, k, f, a in bindings if (oo, k) == (o, call)}
                go(callee, f"{instance}.{call}" if instance else call, inner, within + [callee], join(c), level + 1)

    go("", "", {}, [], "", 0)
    return out


def test_inlined_as_by_recursion(spark):
    r = random.Random(7)
    functions = [f"f{i}" for i in range(5)]
    names = ["x", "y", "t", "en"]
    calls, bindings = [], []
    for o in ["", *functions]:
        for k in range(2):
            calls.append((o, f"c{k}", r.choice(functions), r.choice(["", None, "en", "x > 2 && t"])))
            bindings += [(o, f"c{k}", f, a) for f, a in zip(("x", "y"), r.choice([("a", "b"), ("x", "t"), ("x + en", "y"), ("7", "t")]))]
    edges = sorted({(o, r.choice([*names, "x + y", "x * x", "3"]), r.choice(names), r.choice(["", "en or t", "!(x)", "y == 1"])) for o in ["", *functions] for _ in range(4)})
    found = inline.inlined(spark.createDataFrame(calls, CALLS), spark.createDataFrame(bindings, BINDINGS), spark.createDataFrame(edges, EDGES))
    rows = [tuple(x) for x in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain(calls, bindings, edges)
    assert max(x[2] for x in rows) > 2
    cut = {tuple(x) for x in inline.recursive(spark.createDataFrame(calls, CALLS)).collect()}
    to = {(o, c) for o, _, c, _ in calls if o}
    for _ in functions:
        to |= {(a, d) for a, b in to for c, d in to if b == c}
    assert cut == {(o, k, c) for o, k, c, _ in calls if o and (o == c or (c, o) in to)}


def test_names_selects_and_literals(spark):
    calls = spark.createDataFrame([("", "u", "f", "go"), ("", "v", "none", "")], CALLS)
    bindings = spark.createDataFrame([("", "u", "s", "bus"), ("", "u", "s", "bvs"), ("", "u", "y", "out[3]"), ("", "u", None, "q"), ("", "u", "w", None)], BINDINGS)
    edges = spark.createDataFrame([("f", "s.data[i]", "y", "s.valid && 8'hFF == p::K"), ("f", "4'b1", "y", "posedge w"), ("f", "{s, $clog2(n)}", "t.a", ""), ("", "p", "q", "x + 1")], EDGES)
    rows = {tuple(x)[3:] for x in inline.inlined(calls, bindings, edges).collect()}
    assert rows == {
        ("p", "q", "x + 1"), ("bus.data[u.i]", "out[3]", "go && bus.valid && 8'hFF == p::K"), ("4'b1", "out[3]", "go && posedge u.w"), ("bus", "t.a", "go"), ("u.n", "t.a", "go"),
    }


def test_nothing_to_inline(spark):
    empty = [spark.createDataFrame([], s) for s in (CALLS, BINDINGS, EDGES)]
    assert inline.inlined(*empty).collect() == [] and inline.recursive(empty[0]).collect() == []


def test_schedule(spark):
    # in -Add-> a -wire-> b -Multiply-> c -> r (Subtract, with in) -> d -Add-> r2, and a loop e <-> f without a register behind d.
    edges = [("in", "a"), ("k", "a"), ("a", "b"), ("b", "c"), ("in", "c"), ("c", "r"), ("in", "r"), ("r", "d"), ("d", "r2"), ("r2", "d"), ("d", "e"), ("e", "f"), ("f", "e"), ("f", "g"), ("x", "y"), ("clk", "r")]
    ops = {("in", "a"): "Add", ("k", "a"): "Add", ("b", "c"): "Multiply", ("in", "c"): "Multiply", ("c", "r"): "Subtract", ("in", "r"): "Subtract", ("r2", "d"): "Concat", ("d", "r2"): "Add", ("d", "e"): "Add", ("f", "g"): "LessThan", ("x", "y"): "Add"}
    kinds = [(v, {"in": "PORT_IN", "clk": "PORT_IN", "r": "REG", "r2": "REG"}.get(v, "WIRE")) for v in sorted({x for e in edges for x in e})]
    g = test_graph.graph(spark, edges, kinds)
    op = F.lit(None).cast("string")
    for (s, d), o in ops.items():
        op = F.when((F.col("src") == s) & (F.col("dst") == d), o).otherwise(op)
    found = {r["dst"]: tuple(r)[1:] for r in timing.schedule(g, op).collect()}
    assert found == {
        "a": ("Add", "+", 0, 1, 2), "c": ("Multiply", "×", 0, 2, 2), "r": ("Subtract", "−", 0, 3, 2), "d": ("Concat", "Concat", 1, 1, 1), "r2": ("Add", "+", 1, 2, 1),
        "e": ("Add", "+", 1, 2, 1), "g": ("LessThan", "<", 1, 3, 1), "y": ("Add", "+", 0, 1, 1),
    }


def test_weights_of_longest_paths(spark):
    e = spark.createDataFrame([("a", "b", 5), ("a", "c", 0), ("c", "b", 1), ("c", "b", 7), ("b", "d", 0), ("d", "b", 9)], "src string, dst string, w int")
    rows = sorted(tuple(x) for x in timing.longest_over_cycles(e, spark.createDataFrame([("a",)], "id string")).collect())
    assert rows == [("a", 0, None), ("b", 7, "c"), ("c", 0, "a")]
