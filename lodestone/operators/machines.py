"""State machines: of registers that constants drive under conditions on their own state, and of case statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..graph import PropertyGraph


def moves(g: PropertyGraph, state: str = "state", module: str | None = None) -> DataFrame:
    """(signal, from_state, to_state, condition, resets) of every vertex named `state`, in a module or alone: one row for each way of
    driving it. The state that comes is the source's last name, the one that is left is what the condition asks for (null if
    nothing); resets marks conditions on a reset alone, and condition is what else must hold, '1' for nothing."""
    e = g.edges.where((F.col("kind") == "DRIVER") & (F.col("dst").endswith(f".{state}") | (F.col("dst") == state)))
    e = e if module is None else e.where(F.col("dst").startswith(f"{module}."))
    c = F.col("condition")
    out = e.select(F.col("dst").alias("signal"), S.current_state(c, state).alias("from_state"), F.element_at(F.split("src", r"\."), -1).alias("to_state"), S.without_state(c, state).alias("condition"), S.is_reset_condition(c).alias("resets"))
    return out.where("to_state != ''").distinct()


def transitions(found: DataFrame) -> DataFrame:
    """moves() → (signal, from_state, to_state, condition) of those that leave a state and are no resets."""
    return found.where("not resets and from_state is not null").select("signal", "from_state", "to_state", "condition")


def states(found: DataFrame) -> DataFrame:
    """moves() → (signal, state, is_reset): every state that is come to or left, each once. The reset state is the one that a reset
    leaves or, if it names none, comes to; of several the least; without a reset the least of all."""
    every = found.select("signal", F.explode(F.array("from_state", "to_state")).alias("state"), F.lit(None).cast("string").alias("r")).where("state is not null")
    reset = found.where("resets").select("signal", F.coalesce("from_state", "to_state").alias("state")).withColumn("r", F.col("state"))
    first = every.union(reset).groupBy("signal").agg(F.coalesce(F.min("r"), F.min("state")).alias("first"))
    return every.select("signal", "state").distinct().join(first, "signal").select("signal", "state", (F.col("state") == F.col("first")).alias("is_reset"))


def summary(found: DataFrame) -> DataFrame:
    """moves() → (signal, module, n_states, n_transitions, reset_state); the module of a bare name is ''."""
    s = states(found).groupBy("signal").agg(F.count("*").alias("n_states"), F.min(F.when(F.col("is_reset"), F.col("state"))).alias("reset_state"))
    t = transitions(found).groupBy("signal").agg(F.count("*").alias("n_transitions"))
    module = F.when(F.col("signal").contains("."), F.regexp_replace("signal", r"\.[^.]*$", "")).otherwise("")
    return s.join(t, "signal", "left").select("signal", module.alias("module"), "n_states", F.coalesce("n_transitions", F.lit(0)).cast("bigint").alias("n_transitions"), "reset_state")


def of_cases(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Control flow, nodes (id, kind, variables: array, expression, state_value) and edges (src, dst, kind, condition) → (variable,
    from_state, to_state, condition): the machine of every variable. Its statement is the condition node that has the variable,
    of several the least; the states are the values of what it matches. from_state is the statement's expression."""
    v = nodes.where("kind = 'CONDITION'").select(F.explode("variables").alias("variable"), "id", "expression")
    first = v.groupBy("variable").agg(F.min(F.struct("id", "expression")).alias("n")).select("variable", F.col("n.id").alias("src"), F.col("n.expression").alias("from_state"))
    target = nodes.where("state_value != ''").select(F.col("id").alias("dst"), F.col("state_value").alias("to_state"))
    match = edges.where("kind = 'CASE_MATCH'").select("src", "dst", F.coalesce("condition", F.lit("")).alias("condition"))
    return first.join(match, "src").join(target, "dst").select("variable", "from_state", "to_state", "condition")
