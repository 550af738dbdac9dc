"""Coverage questions: semi and anti joins of what should be covered with what is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ratio(wanted: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    """(covered, uncovered, per_mille) of the rows of wanted whose key covered has."""
    marks = covered.select(key).distinct().withColumn("hit", F.lit(1))
    out = wanted.join(marks, key, "left").agg(F.count("hit").alias("covered"), F.count_if(F.col("hit").isNull()).alias("uncovered"))
    return out.select("covered", "uncovered", F.floor(F.col("covered") * 1000 / F.greatest(F.lit(1), F.col("covered") + F.col("uncovered"))).cast("bigint").alias("per_mille"))


def uncovered(wanted: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    return wanted.join(covered.select(key).distinct(), key, "left_anti")


def missing_crosses(pairs: DataFrame, points: DataFrame, crosses: DataFrame) -> DataFrame:
    """pairs (a, b) of which points (name) has both and crosses (a, b) has no cross in either order."""
    both = pairs.join(points.select(F.col("name").alias("a")), "a", "left_semi").join(points.select(F.col("name").alias("b")), "b", "left_semi")
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return ordered(both).join(ordered(crosses), ["a", "b"], "left_anti")


def missing_illegal(pairs: DataFrame, points: DataFrame, crosses: DataFrame, bins: DataFrame) -> DataFrame:
    """pairs (a, b) of which points (name) has both and crosses (a, b) has both somewhere, but of which neither has an illegal bin
    in bins (name, kind)."""
    crossed = crosses.select(F.col("a").alias("name")).union(crosses.select("b")).distinct().join(points.select("name"), "name", "left_semi")
    marked = bins.where("kind = 'illegal_bins'").select("name").distinct()
    out = pairs.select("a", "b").distinct()
    for side in ("a", "b"):
        out = out.join(crossed.withColumnRenamed("name", side), side, "left_semi").join(marked.withColumnRenamed("name", side), side, "left_anti")
    return out.select("a", "b")


def gaps(pairs: DataFrame, points: DataFrame, crosses: DataFrame, bins: DataFrame) -> DataFrame:
    """(kind, a, b) of both checks."""
    one = missing_crosses(pairs, points, crosses).select(F.lit("missing_cross").alias("kind"), "a", "b")
    return one.union(missing_illegal(pairs, points, crosses, bins).select(F.lit("missing_illegal_bins"), "a", "b"))


def assertions_of(refs: DataFrame, assertions: DataFrame, signal: str) -> DataFrame:
    """refs (signal, target: an assertion or a property), assertions (id, property) → the assertions that a signal touches."""
    hit = refs.where(F.col("signal") == signal).select("target").distinct()
    return assertions.join(hit.withColumnRenamed("target", "id"), "id", "left_semi").select("id", "property").union(assertions.join(hit.withColumnRenamed("target", "property"), "property", "left_semi").select("id", "property")).distinct()


def signals_of(refs: DataFrame, assertions: DataFrame, id: str) -> DataFrame:
    """The signals of an assertion, or of its property if it has none of its own."""
    own = refs.where(F.col("target") == id).select("signal").distinct()
    of = assertions.where(F.col("id") == id).select(F.col("property").alias("target"))
    return own if not own.isEmpty() else refs.join(of, "target", "left_semi").select("signal").distinct()
