"""Conditions under which statements run, over rows of an ordered statement tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import counted, stored

#: Kinds of rows with a meaning here; any other kind (block, loop, timed, ...) only holds statements. An `if` holds branches in
#: order, one without a condition being the else; a `case` has the subject as its condition and holds items, one without a
#: condition being the default; a `choice` (a ternary expression) holds its two values in order.
BRANCHING = ("if", "case", "choice")


def negated(condition: Column, choice: Column) -> Column:
    """!name, or !(text) for more than a name and for the condition of a choice."""
    return F.when(condition.rlike(r"^\w+$") & ~choice, F.concat(F.lit("!"), condition)).otherwise(F.concat(F.lit("!("), condition, F.lit(")")))


def is_real(condition: Column) -> Column:
    """Whether it is a condition, and not empty or an event."""
    return (condition != "") & ~condition.rlike("posedge|negedge|or ")


def own_conditions(statements: DataFrame) -> DataFrame:
    """statements (id, parent, position, kind, condition; parent null at the top) → the same and own: the conditions that a row
    adds to its parent's, an array in order. A branch adds the negations of its elder siblings and its own condition, an item
    that the subject equals it, a value of a choice the condition or its negation. Null conditions are empty ones."""
    s = statements.select("id", "parent", F.col("position").cast("bigint").alias("position"), "kind", F.coalesce("condition", F.lit("")).alias("condition"))
    above = s.where(F.col("kind").isin(*BRANCHING)).select(F.col("id").alias("parent"), F.col("kind").alias("holder"), F.col("condition").alias("subject"))
    s = s.join(above, "parent", "left")
    elder = Window.partitionBy("parent").orderBy("position", "id").rowsBetween(Window.unboundedPreceding, -1)
    no = F.when((F.col("holder") == "if") & is_real(F.col("condition")), negated(F.col("condition"), F.lit(False)))
    # Only branches have elders that matter; the tops of trees are not gathered as each other's siblings.
    branches = s.where("holder = 'if'").withColumn("own", F.concat(F.coalesce(F.collect_list(no).over(elder), F.array().cast("array<string>")), F.when(is_real(F.col("condition")), F.array("condition")).otherwise(F.array().cast("array<string>"))))
    values = s.where("holder = 'choice'").withColumn("place", F.row_number().over(Window.partitionBy("parent").orderBy("position", "id")))
    values = values.withColumn("own", F.array(F.when(F.col("place") == 1, F.col("subject")).otherwise(negated(F.col("subject"), F.lit(True))))).drop("place")
    item = F.when(F.col("condition") == "", "default").otherwise(F.col("condition"))
    items = s.where("holder = 'case'").withColumn("own", F.array(F.when(F.col("subject") == "", item).otherwise(F.concat_ws(" == ", "subject", item))))
    rest = s.where("holder is null").withColumn("own", F.array().cast("array<string>"))
    out = branches.unionByName(values).unionByName(items).unionByName(rest)
    return out.select("id", "parent", "position", "kind", "condition", "own")


def path_conditions(statements: DataFrame) -> DataFrame:
    """statements (as above) → (id, kind, level, condition): of every row the conditions of all branches that it is in, from the
    outermost, joined by &&. Level by level from the tops; rows on a parent cycle, or under a missing parent, aren't reached."""
    own = stored(own_conditions(statements))
    steps = own.select(F.col("parent").alias("at"), "id", "kind", "own").where("at is not null")
    now = stored(own.where("parent is null").select("id", "kind", F.col("own").alias("path")))
    out, level = now.withColumn("level", F.lit(0).cast("bigint")), 0
    while True:
        level += 1
        now, n = counted(now.select(F.col("id").alias("at"), "path").join(steps, "at").select("id", "kind", F.concat("path", "own").alias("path")))
        if not n:
            break
        out = out.unionByName(now.withColumn("level", F.lit(level).cast("bigint")))
    return out.select("id", "kind", "level", F.array_join("path", " && ").alias("condition"))
