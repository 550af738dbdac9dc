"""Calls of functions and tasks, replaced by the edges of their bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..storage import counted, stored
from .constants import BASED
from .traverse import reach

NAME = r"[A-Za-z_][\w$]*(?:(?:\.|::)[A-Za-z_][\w$]*)*"
WORD = rf"(?s){BASED}|\$\w+|{NAME}|\d\w*|."
SIMPLE = rf"^{NAME}(?:\[[^\]]*\])*$"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _is_name(word: Column) -> Column:
    return word.rlike("^[A-Za-z_]") & ~word.isin(*S.KEYWORDS)


def renamed(text: Column, names: Column, instance: Column, whole: bool = False) -> Column:
    """The text of a body as its instance has it: what is bound has the name (or text) of its map, names in other places (a.b, p::x)
    stay unless a is bound, and all others get the instance in front. whole: texts that are more than a name stand in parentheses."""

    def bound(key: Column) -> Column:
        out = F.try_element_at(names, key)
        return F.when(out.rlike(SIMPLE) | out.rlike(r"^[\w']+$"), out).otherwise(F.concat(F.lit("("), out, F.lit(")"))) if whole else out

    def word(w: Column) -> Column:
        head, rest = F.regexp_extract(w, r"^(.*?)(?:\.|::)", 1), F.regexp_extract(w, r"^.*?((?:\.|::).*)$", 1)
        far = F.when(rest != "", F.coalesce(F.concat(F.when(head != "", bound(head)), rest), w))
        return F.when(_is_name(w), F.coalesce(bound(w), far, F.concat_ws(".", instance, w))).otherwise(w)

    return F.when(instance == "", text).otherwise(F.array_join(F.transform(_words(text), word), ""))


def sources(text: Column) -> Column:
    """The vertices that a source stands for: itself, if it is a name with or without a select; of an expression its names; of a
    constant its text."""
    found = F.array_distinct(F.filter(_words(text), _is_name))
    return F.when(text.rlike(SIMPLE) | (F.size(found) == 0), F.array(text)).otherwise(found)


def recursive(calls: DataFrame) -> DataFrame:
    """calls (owner, call, callee) → those whose callee calls their owner again, however far."""
    steps = calls.select(F.col("owner").alias("src"), F.col("callee").alias("dst")).where("src != ''").distinct()
    back = reach(steps, steps.select(F.col("src").alias("root"), F.col("src").alias("id")).distinct()).select(F.col("root").alias("callee"), F.col("id").alias("owner"))
    own = steps.where("src = dst").select(F.col("src").alias("callee"), F.col("dst").alias("owner"))
    return calls.join(back.union(own).distinct(), ["callee", "owner"], "left_semi").select("owner", "call", "callee")


def inlined(calls: DataFrame, bindings: DataFrame, edges: DataFrame) -> DataFrame:
    """calls (owner, call, callee, condition), bindings (owner, call, formal, actual), edges (owner, src, dst, condition) → (instance, function,
    level, src, dst, condition): the edges of the top (owner '') and, for every call, of the body of what it calls.

    An owner is a function or task, '' being the top; call names a call within its owner. Formals are replaced by the actuals of
    the call, a result's formal too; the other names of a body are made fresh by the instance, the calls that lead to it joined by
    dots. The conditions of these calls come before those of a body's edges. Of several actuals of a formal the
    least counts, an unbound formal is fresh as any other name; null conditions are empty. Functions without a body give no edges.

    Round by round, a level of calls each. A call of a function that is being expanded already isn't expanded again
    (recursive() has these calls), so a level is no deeper than there are functions. Each instance is a row with the names of its
    function's formals; how many there are is how many copies inlining makes."""
    text = lambda c: F.coalesce(c, F.lit(""))
    one = bindings.groupBy("owner", "call", "formal").agg(F.min("actual").alias("actual")).where("formal is not null and actual is not null")
    bound = one.groupBy("owner", "call").agg(F.collect_list(F.struct("formal", "actual")).alias("bound"))
    none = F.array().cast("array<struct<formal:string,actual:string>>")
    sites = calls.select("owner", "call", "callee", text("condition").alias("own")).distinct().join(bound, ["owner", "call"], "left")
    sites = stored(sites.select(F.col("owner").alias("function"), "call", "callee", "own", F.coalesce("bound", none).alias("bound")))
    body = stored(edges.select(F.col("owner").alias("function"), "src", "dst", text("condition").alias("own")).distinct())
    now = calls.sparkSession.range(1).select(F.lit("").alias("instance"), F.lit("").alias("function"), F.create_map().cast("map<string,string>").alias("names"), F.array().cast("array<string>").alias("within"), F.lit("").alias("condition"))
    names, instance, known, above, level, out = F.col("names"), F.col("instance"), F.col("known"), F.col("above"), 0, None
    joined = lambda own: F.concat_ws(" && ", F.when(F.col("condition") != "", F.col("condition")), F.when(own != "", own))
    # The caller's columns have names of their own, as a select's new columns may be meant where lambdas name them.
    actual = F.transform("bound", lambda b: F.struct(b["formal"].alias("key"), renamed(b["actual"], known, above).alias("value")))
    path = F.when(above == "", F.col("call")).otherwise(F.concat_ws(".", above, "call"))
    now, n = counted(now)
    while n:
        found = now.join(body, "function").select("instance", "function", F.lit(level).cast("bigint").alias("level"), F.explode(sources(renamed(F.col("src"), names, instance))).alias("src"), renamed(F.col("dst"), names, instance).alias("dst"), joined(renamed(F.col("own"), names, instance, True)).alias("condition"))
        out = found if out is None else out.unionByName(found)
        level += 1
        met = now.withColumnsRenamed({"instance": "above", "names": "known"}).join(sites, "function").where(~F.array_contains("within", F.col("callee")))
        now, n = counted(met.select(path.alias("instance"), F.col("callee").alias("function"), F.map_from_entries(actual).alias("names"), F.concat("within", F.array("callee")).alias("within"), joined(renamed(F.col("own"), known, above, True)).alias("condition")))
    return out.distinct()
