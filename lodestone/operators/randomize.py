"""Random variables of classes: whether what is made at random is ever used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WITH = "randomize_with_constraint"


def reachability(variables: DataFrame, calls: DataFrame, references: DataFrame, points: DataFrame) -> DataFrame:
    """variables (class, name, kind), calls (kind, inline), references (name, kind), points (covergroup, signal) → (class, name,
    kind, status, randomized, consumed, covered).

    randomized: the calls without a constraint, which make everything random, and those whose inline constraint holds the name,
    also within a longer word; consumed: references other than declarations; covered: coverpoints. Alive is what is consumed or
    covered, else dead. A repeated variable counts once; null inline texts hold nothing.

    Names and constraints meet by equal text, not all with all: each distinct word of a constraint is there under its parts that are
    no longer than the longest name, of which those that are no name leave at once."""
    v = variables.select("class", "name", "kind").distinct()
    names = v.select("name").distinct()
    inline = calls.where(F.col("kind") == WITH).select("inline").groupBy("inline").agg(F.count("*").alias("n"))
    words = inline.select("inline", "n", F.explode(F.array_distinct(F.regexp_extract_all("inline", F.lit(r"[\w$]+"), 0))).alias("word"))
    longest = names.agg(F.greatest(F.coalesce(F.max(F.length("name")), F.lit(1)), F.lit(1)).alias("longest"))
    ends = lambda i: F.sequence(F.lit(1), F.least(F.col("longest"), F.length("word") - i + 1))
    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.transform(ends(i), lambda k: F.substring("word", i, k))))
    per_word = words.select("word").distinct().join(longest).select("word", F.explode(F.array_distinct(parts)).alias("name")).join(names, "name", "left_semi")
    hits = words.join(per_word, "word").select("inline", "n", "name").distinct().groupBy("name").agg(F.sum("n").alias("named"))
    free = calls.where(~F.col("kind").eqNullSafe(F.lit(WITH))).agg(F.count("*").alias("free"))
    used = references.where("kind != 'decl'").groupBy("name").agg(F.count("*").alias("consumed"))
    seen = points.groupBy(F.col("signal").alias("name")).agg(F.count("*").alias("covered"))
    out = v.join(hits, "name", "left").join(used, "name", "left").join(seen, "name", "left").na.fill(0, ["named", "consumed", "covered"]).join(free)
    status = F.when((F.col("consumed") > 0) | (F.col("covered") > 0), "alive").otherwise("dead")
    return out.select("class", "name", "kind", status.alias("status"), (F.col("named") + F.col("free")).alias("randomized"), "consumed", "covered")


def totals(found: DataFrame) -> DataFrame:
    """reachability() → (class, n, alive, dead)."""
    return found.groupBy("class").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "alive").alias("alive"), F.count_if(F.col("status") == "dead").alias("dead"))
