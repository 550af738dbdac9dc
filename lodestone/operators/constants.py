"""Constant expressions, as of widths: evaluated by a fold over an array of tokens; parameters that refer to others, to a fixed point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Segments, counted, stored

BASED = r"\d*\s*'[sS]?[bodhBODH][0-9a-fA-FxXzZ?_]+"
NAME = r"[A-Za-z_][\w$]*(?:::[A-Za-z_][\w$]*)*"
TOKEN = rf"{BASED}|\d[\d_]*|\$?{NAME}|\S"
LOG = "$clog2"
VALUES = "map<string,bigint>"


def tokens(text: Column) -> Column:
    """Numbers, names (with the packages that they are in), and single characters."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def names(text: Column) -> Column:
    """The names of parameters in an expression, distinct."""
    return F.array_distinct(F.filter(tokens(text), lambda t: t.rlike("^[A-Za-z_]")))


def number(token: Column) -> Column:
    """The value of a decimal or based literal; null for digits x or z and for what a long can't hold."""
    digits = F.regexp_replace(F.regexp_replace(F.regexp_extract(token, r"'[sS]?[bodhBODH](.*)$", 1), "_", ""), "^0+(?=.)", "")
    base = F.lower(F.regexp_extract(token, r"'[sS]?([bodhBODH])", 1))
    out = F.when(token.rlike(r"^\d[\d_]*$"), F.regexp_replace(token, "_", "").try_cast("bigint"))
    for letter, radix, pattern in (("b", 2, "^[01]{1,62}$"), ("o", 8, "^[0-7]{1,20}$"), ("d", 10, "^[0-9]{1,18}$"), ("h", 16, "^[0-9a-fA-F]{1,15}$")):
        out = out.when((base == letter) & digits.rlike(pattern), F.conv(F.when(digits.rlike(pattern), digits), radix, 10).try_cast("bigint"))
    return out


def _let(value: Column, use) -> Column:
    """use(value), the value being evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _minus(a: Column, b: Column) -> Column:
    return F.try_subtract(a, b)


def _ratio(a: Column, b: Column, rest: bool) -> Column:
    """Quotient rounded down, or its remainder, which has the sign of the divisor; by 0 it is 0."""
    some = F.when((b != 0) & (b != -1), b)
    left = a % some
    off = (left != 0) & ((left < 0) != (b < 0))
    if rest:
        return F.when(a.isNull() | b.isNull(), F.lit(None)).when(b.isin(0, -1), F.lit(0).cast("bigint")).otherwise(F.when(off, left + b).otherwise(left))
    whole = F.call_function("div", a, some)
    zero = F.lit(0).cast("bigint")
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(b == 0, zero).when(b == -1, _minus(zero, a)).otherwise(F.when(off, whole - 1).otherwise(whole))


def _log(x: Column) -> Column:
    """Bits that tell x values apart; 0 for 1 and less."""
    return F.when(x <= 1, F.lit(0)).when(x.isNotNull(), F.length(F.bin(x - 1))).cast("bigint")


def _rank(op: Column) -> Column:
    """How strongly an operator binds; 0 for what isn't reduced."""
    return F.when(op.isin("+", "-"), 1).when(op.isin("*", "/", "%"), 2).when(op.isin("pos", "neg"), 3).otherwise(0)


def _cut(a: Column, n: int) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - n, F.lit(0)))


def _state(vals: Column, ops: Column, want: Column, ok: Column) -> Column:
    return F.struct(vals.cast("array<bigint>").alias("vals"), ops.cast("array<string>").alias("ops"), want.alias("want"), ok.alias("ok"))


def _push(a: Column, x: Column) -> Column:
    return F.concat(a, F.array(x))


def _reduced(state: Column, least: Column) -> Column:
    """The state after all operators on top of the stack that bind as strongly as `least` have been applied."""

    def once(s: Column, _: Column) -> Column:
        op, a, b = (F.try_element_at(s["ops"], F.lit(-1)), F.try_element_at(s["vals"], F.lit(-2)), F.try_element_at(s["vals"], F.lit(-1)))
        two = F.when(op == "+", F.try_add(a, b)).when(op == "-", _minus(a, b)).when(op == "*", F.try_multiply(a, b)).when(op == "/", _ratio(a, b, False)).when(op == "%", _ratio(a, b, True))
        one = F.when(op == "neg", _minus(F.lit(0).cast("bigint"), b)).otherwise(b)
        vals = F.when(op.isin("pos", "neg"), _push(_cut(s["vals"], 1), one)).otherwise(_push(_cut(s["vals"], 2), two))
        return F.when(_rank(op) >= least, _state(vals, _cut(s["ops"], 1), s["want"], s["ok"])).otherwise(s)

    return F.aggregate(state["ops"], state, once)


def evaluate(text: Column, values: Column) -> Column:
    """The value of an expression of + - * / %, signs, parentheses and $clog2, names having the values of a map; null if a name
    has none, if it is too large for a long, or if it is no such expression. A null text is 0, as a bound that isn't there is.

    Two stacks, of values and operators, go along the tokens: an operator applies those above it that bind as strongly."""
    true, false = F.lit(True), F.lit(False)

    def step(s: Column, t: Column) -> Column:
        text, vals, ops, want = t["text"], s["vals"], s["ops"], s["want"]
        wrong = _state(vals, ops, want, false)

        def closed(r: Column) -> Column:
            inner, log = _cut(r["ops"], 1), F.coalesce(F.try_element_at(r["ops"], F.lit(-2)) == LOG, false)
            of = F.when(log, _push(_cut(r["vals"], 1), _log(F.try_element_at(r["vals"], F.lit(-1))))).otherwise(r["vals"])
            return _state(of, F.when(log, _cut(inner, 1)).otherwise(inner), false, F.coalesce(F.try_element_at(r["ops"], F.lit(-1)) == "(", false))

        binary = lambda r: _state(r["vals"], _push(r["ops"], text), true, true)
        as_operand = F.when(text.isin("(", LOG), _state(vals, _push(ops, text), true, true)).when(text == "-", _state(vals, _push(ops, F.lit("neg")), true, true))
        as_operand = as_operand.when(text == "+", _state(vals, _push(ops, F.lit("pos")), true, true)).when(t["operand"], _state(_push(vals, t["value"]), ops, false, true)).otherwise(wrong)
        behind = F.when(text == ")", _let(_reduced(s, F.lit(1)), closed)).when(_rank(text) > 0, _let(_reduced(s, _rank(text)), binary)).otherwise(wrong)
        return F.when(~s["ok"], s).when(want, as_operand).otherwise(behind)

    name = lambda t: t.rlike("^[A-Za-z_]")
    items = F.transform(tokens(text), lambda t: F.struct(t.alias("text"), (name(t) | t.rlike(rf"^(?:\d|{BASED})")).alias("operand"), F.when(name(t), F.try_element_at(values, t)).otherwise(number(t)).alias("value")))
    end = lambda s: F.when(s["ok"] & ~s["want"] & (F.size(s["ops"]) == 0) & (F.size(s["vals"]) == 1), F.try_element_at(s["vals"], F.lit(1)))
    none = _state(F.array(), F.array(), true, true)
    return F.when(text.isNull(), F.lit(0).cast("bigint")).otherwise(F.aggregate(items, none, step, lambda s: _let(_reduced(s, F.lit(1)), end)))


def _references(texts: DataFrame) -> DataFrame:
    """texts (scope, text, ...) → the same, ref, in_scope, name_: each name of a text and where it is defined: behind its package, or
    else in the text's own scope."""
    out = texts.withColumn("ref", F.explode(names(F.col("text"))))
    package, last = F.regexp_extract("ref", "^(.*)::", 1), F.regexp_extract("ref", r"([^:]+)$", 1)
    return out.withColumn("in_scope", F.when(package == "", F.col("scope")).otherwise(package)).withColumn("name_", last)


def _gathered() -> Column:
    return F.map_from_entries(F.collect_list(F.struct("ref", "value"))).cast(VALUES)


def resolve(parameters: DataFrame) -> DataFrame:
    """parameters (scope, name, text) → (scope, name, text, value): the value of each parameter, from those that it refers to, in its own
    scope or, as package::name, in another one. Of several texts of a name the least counts. Null for those that refer to
    themselves, however far, or to what isn't defined or has no value.

    Round by round: a round reads those that the last round's parameters are named in, and each is evaluated once, when
    the last of its names has a value. Null scopes and names go."""
    own = stored(parameters.where("scope is not null and name is not null").groupBy("scope", "name").agg(F.min("text").alias("text")))
    refs = stored(_references(own))
    value = evaluate(F.col("text"), F.col("values")).alias("value")
    alone = own.where(F.size(names(F.coalesce("text", F.lit("")))) == 0).withColumn("values", F.create_map().cast(VALUES))
    new, n = counted(alone.select("scope", "name", value))
    known = Segments(new, n)
    while n:
        met = new.select(F.col("scope").alias("in_scope"), F.col("name").alias("name_"))
        touched = refs.join(met, ["in_scope", "name_"], "left_semi").select("scope", "name").distinct()
        have = known.table().select(F.col("scope").alias("in_scope"), F.col("name").alias("name_"), "value", F.lit(True).alias("hit"))
        each = refs.join(touched, ["scope", "name"], "left_semi").join(have, ["in_scope", "name_"], "left")
        each = each.groupBy("scope", "name", "text").agg(F.count("*").alias("n"), F.count("hit").alias("hits"), _gathered().alias("values"))
        new, n = counted(each.where("n = hits").select("scope", "name", value))
        known.add(new, n)
    return own.join(known.table(), ["scope", "name"], "left")


def fold(expressions: DataFrame, values: DataFrame) -> DataFrame:
    """expressions (scope, text, ...), values of resolve() → the same and value. Each distinct expression of a scope is evaluated once."""
    each = expressions.select("scope", "text").distinct()
    have = values.select(F.col("scope").alias("in_scope"), F.col("name").alias("name_"), "value")
    found = _references(each).join(have, ["in_scope", "name_"]).groupBy("scope", "text").agg(_gathered().alias("values"))
    found = found.withColumnsRenamed({"scope": "scope_", "text": "text_"})
    met = each.join(found, F.col("scope").eqNullSafe(F.col("scope_")) & F.col("text").eqNullSafe(F.col("text_")), "left")
    met = met.select(F.col("scope").alias("scope_"), F.col("text").alias("text_"), evaluate(F.col("text"), F.coalesce("values", F.create_map().cast(VALUES))).alias("value"))
    out = expressions.join(stored(met), F.col("scope").eqNullSafe(F.col("scope_")) & F.col("text").eqNullSafe(F.col("text_")), "left")
    return out.drop("scope_", "text_")
