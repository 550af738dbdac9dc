"""Constant expressions and parameters, against plain Python."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lodestone.functions import scalars
from lodestone.operators import constants


def values(spark, texts, **known):
    given = F.create_map(*[F.lit(x) for kv in known.items() for x in kv]).cast(constants.VALUES)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", constants.evaluate(F.col("t"), given).alias("v")).orderBy("i").collect()]


CASES = [
    ("8 - 1", 7), ("2+3*4", 14), ("(2+3)*4", 20), ("10 - 4 - 3", 3), ("7 / 2", 3), ("-7 / 2", -4), ("-7 % 3", 2), ("7 % -3", -2), ("5 / 0", 0), ("5 % 0", 0), ("7 % -1", 0), ("7 / -1", -7),
    ("- - 3", 3), ("2 - -+-3", -1), ("-(2 + 3) * 2", -10), ("W-1", 7), ("pkg::D * W", 24), ("W + NONE", None), ("NONE / 0", None), ("$clog2(1)", 0), ("$clog2(0)", 0), ("$clog2(9) + 1", 5),
    ("$clog2((W) * 2)", 4), ("$clog2(W) * $clog2(W - 3)", 9), ("8'hFF", 255), ("4'b10_10 + 1", 11), ("12'sd5", 5), ("6'o17", 15), ("4'bx1", None), ("1_000", 1000), ("'h10", 16), ("9'd007", 7),
    ("", None), (None, 0), ("1 +", None), ("(1", None), ("1)", None), ("()", None), ("1 2", None), ("* 2", None), ("a & b", None), ("$clog2 4", None), ("$clog2 + (4)", None), ("99999999999999999999", None),
    ("9223372036854775807 + 1", None), ("W W", None), ("64'hFFFFFFFFFFFFFFFF", None), ("((((W))))", 8), ("2*-3", -6),
]


def test_evaluate(spark):
    found = values(spark, [t for t, _ in CASES], W=8, **{"pkg::D": 3})
    assert [(t, f) for (t, _), f in zip(CASES, found)] == CASES


def expression(r, depth):
    if depth == 0 or r.random() < 0.2:
        return r.choice(["W", "D", str(r.randrange(1, 50))])
    if r.random() < 0.15:
        return "-" + expression(r, 0)
    a, b = expression(r, depth - 1), expression(r, depth - 1)
    out = f"{a} {r.choice('+-*/%')} {b}"
    return f"({out})" if r.random() < 0.5 else out


def test_random_expressions(spark):
    r = random.Random(5)
    texts, want = [], []
    while len(texts) < 300:
        t = expression(r, 4)
        try:
            v = eval(t.replace("/", "//"), {"W": 7, "D": -3})  # noqa: S307  our own arithmetic; floor division is its meaning
        except ZeroDivisionError:
            continue
        if abs(v) < 2**62:
            texts.append(t)
            want.append(v)
    assert values(spark, texts, W=7, D=-3) == want


PARAMETERS = [
    ("m", "W", "8"), ("m", "B", "W - 1"), ("m", "C", "B * W + pkg::X"), ("pkg", "X", "Y * 2"), ("pkg", "Y", "5"), ("m", "L1", "L2 + 1"), ("m", "L2", "L1"), ("m", "S", "S"), ("m", "U", "nowhere + 1"),
    ("m", "V", "U"), ("m", "BAD", "1 +"), ("m", "W2", "BAD + 1"), ("m", "T", "9"), ("m", "T", "3"), ("m", "N", None), ("n", "W", "m::C - 1"), ("m", "D", "W + W + B + B"), (None, "W", "1"), ("m", None, "1"),
]


def test_parameters_to_a_fixed_point(spark):
    p = spark.createDataFrame(PARAMETERS, "scope string, name string, text string")
    found = {(r.scope, r.name): r.value for r in constants.resolve(p).collect()}
    assert found == {
        ("m", "W"): 8, ("m", "B"): 7, ("m", "C"): 66, ("pkg", "X"): 10, ("pkg", "Y"): 5, ("m", "L1"): None, ("m", "L2"): None, ("m", "S"): None, ("m", "U"): None, ("m", "V"): None,
        ("m", "BAD"): None, ("m", "W2"): None, ("m", "T"): 3, ("m", "N"): 0, ("n", "W"): 65, ("m", "D"): 30,
    }
    e = spark.createDataFrame([(1, "m", "W + D"), (1, "m", "W + D"), (2, "n", "W"), (3, "n", "pkg::X - 1"), (4, None, "3"), (5, "m", None), (6, None, "W"), (7, "m", "a[2]")], "k int, scope string, text string")
    rows = sorted((r.k, r.scope, r.value) for r in constants.fold(e.where("k < 4"), constants.resolve(p)).collect())
    assert rows == [(1, "m", 38), (1, "m", 38), (2, "n", 65), (3, "n", 9)]
    assert {r.k: r.value for r in constants.fold(e.where("k > 3"), constants.resolve(p)).collect()} == {4: 3, 5: 0, 6: None, 7: None}


def test_long_chains(spark):
    n = 12  # more rounds than levels are kept apart
    rows = [("s", f"P{i}", f"P{i - 1} + 1" if i else "1") for i in range(n)]
    found = {r.name: r.value for r in constants.resolve(spark.createDataFrame(rows, "scope string, name string, text string")).collect()}
    assert found == {f"P{i}": i + 1 for i in range(n)}


def test_no_parameters(spark):
    empty = spark.createDataFrame([], "scope string, name string, text string")
    assert constants.resolve(empty).collect() == []
    assert [r.value for r in constants.fold(spark.createDataFrame([("s", "4 * 4")], "scope string, text string"), constants.resolve(empty)).collect()] == [16]


def test_based_numbers_are_no_signals(spark):
    texts = ["a & 8'B1010", "x[3:0] + 4'hF - 'b0 & 12'sD5 | y_d.z[2]", "8'b1x_0 ^ q ^ 16'SHffz?", "if (a_b or 32'd100)"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", scalars.atomics(F.col("t"))).orderBy("i").collect()
    assert [r[1] for r in rows] == [["a"], ["x[3:0]", "y_d.z[2]"], ["q"], ["a_b"]]
