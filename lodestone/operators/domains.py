"""Clock domains, crossings, synchronisers, register depth, state machines and control flow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..graph import PropertyGraph
from ..storage import counted, stored
from .traverse import reach


def assign(g: PropertyGraph) -> DataFrame:
    """(id, domain): registers by the clock that drives them, ties by the smallest."""
    return g.kept("domains", lambda: _assign(g), "id")


def _assign(g: PropertyGraph) -> DataFrame:
    clocked = g.edges.where(F.col("kind") == "CLOCK").join(g.vertices.where(F.col("kind") == "REG").select(F.col("id").alias("dst")), "dst", "left_semi")
    return clocked.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("domain"))


def spread(g: PropertyGraph, depth: int) -> DataFrame:
    """(id, domain): assign(), and other vertices that registers of one domain or more reach without passing another
    register, by (level, domain)."""
    own = assign(g)
    inner = g.edges.where(~F.col("kind").isin("CLOCK", "RESET")).join(own.select(F.col("id").alias("dst")), "dst", "left_anti")
    found = reach(inner, own.select(F.col("domain").alias("root"), "id"), depth)
    return own.unionByName(found.groupBy("id").agg(F.min(F.struct("level", "root")).alias("m")).select("id", F.col("m.root").alias("domain")))


def crossings(g: PropertyGraph) -> DataFrame:
    """(src, dst, kind, condition, src_domain, dst_domain): top edges between registers of different domains."""
    return g.kept("crossings", lambda: _crossings(g))


def _crossings(g: PropertyGraph) -> DataFrame:
    d = assign(g)
    # Ends come first: edges lie in buckets of them, and only those into registers are shuffled to their sources.
    e = g.top_into(d).where(~F.col("kind").isin("CLOCK", "RESET")).select("src", "dst", "kind", "condition")
    e = e.join(d.select(F.col("id").alias("dst"), F.col("domain").alias("dst_domain")), "dst")
    e = g.parted(e, "src").join(d.select(F.col("id").alias("src"), F.col("domain").alias("src_domain")), "src")
    return e.where("src_domain != dst_domain").select("src", "dst", "kind", "condition", "src_domain", "dst_domain")


def crossing_counts(found: DataFrame) -> DataFrame:
    """Crossings by pair of domains, by source domain, and in all ('' stands for all)."""
    return found.rollup("src_domain", "dst_domain").agg(F.count("*").alias("n")).na.fill("", ["src_domain", "dst_domain"])


def synchronisers(g: PropertyGraph, found: DataFrame, depth: int | None = None) -> DataFrame:
    """(dst, n_regs, sync): registers of the target's own domain that follow a crossing's target over registers of that
    domain only, the target included, to the end of the chain or within `depth` hops; 1 is NONE, n is n-FLOP."""
    d = assign(g)
    reg = g.edges.where(F.col("kind") == "DRIVER").select("src", "dst").distinct().join(d.select(F.col("id").alias("dst"), F.col("domain").alias("y")), "dst")
    reg = stored(g.parted(reg, "src").join(d.select(F.col("id").alias("src"), F.col("domain").alias("x")), "src").where("x = y").select("src", "dst"))
    targets = stored(found.select("dst").distinct())
    after = reach(reg, targets.select(F.col("dst").alias("root"), F.col("dst").alias("id")), depth).where("root != id").groupBy("root").agg(F.count("*").alias("k"))
    n = F.coalesce("k", F.lit(0)) + 1
    return targets.join(after, targets["dst"] == after["root"], "left").select("dst", n.cast("bigint").alias("n_regs"), F.when(n == 1, "NONE").otherwise(F.concat(n.cast("string"), F.lit("-FLOP"))).alias("sync"))


def state_machine(g: PropertyGraph, state: str = "state") -> DataFrame:
    """(from_state, to_state, condition) of DRIVER edges; the state left is read from the condition, or is the source."""
    e = g.edges.where(F.col("kind") == "DRIVER")
    return e.select(F.coalesce(S.current_state(F.col("condition"), state), F.col("src")).alias("from_state"), F.col("dst").alias("to_state"), S.without_state(F.col("condition"), state).alias("condition")).distinct()


def conditioned(g: PropertyGraph) -> DataFrame:
    """(id, n_conditions, n_sources) of vertices that an edge with a condition enters."""
    e = g.edges.where("condition != ''")
    return e.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("condition").alias("n_conditions"), F.count_distinct("src").alias("n_sources"))


def opposed(g: PropertyGraph) -> DataFrame:
    """(id, a, b): pairs of conditions into a vertex of which one is the other's negation. The bare text is the join key, so
    conditions are only compared with those they can oppose."""
    c = g.edges.where("condition != ''").select(F.col("dst").alias("id"), "condition", F.regexp_replace("condition", "[! ]", "").alias("bare")).distinct()
    a = c.where(F.col("condition").startswith("!")).select("id", "bare", F.col("condition").alias("a"))
    b = c.where(~F.col("condition").startswith("!")).select("id", "bare", F.col("condition").alias("b"))
    return a.join(b, ["id", "bare"]).select("id", "a", "b")


def register_steps(g: PropertyGraph) -> DataFrame:
    """Edges without clocks and resets between registers, or from an input port to a register."""
    regs = g.vertices.where("kind = 'REG'").select(F.col("id").alias("dst"))
    e = g.edges.where(~F.col("kind").isin("CLOCK", "RESET")).select("src", "dst").distinct().join(regs, "dst", "left_semi")
    sources = g.vertices.where("kind in ('REG', 'PORT_IN', 'SIGNAL')").select(F.col("id").alias("src"))
    return g.parted(e, "src").join(sources, "src", "left_semi").select("src", "dst")


def components(edges: DataFrame) -> DataFrame:
    """edges (src, dst) → (id, component: its least vertex) of the strongly connected components of two vertices or more; other
    vertices are components of their own and not returned.

    Vertices without a way in or a way out are taken off until none is left. Of the rest each gets the least vertex that
    reaches it; that vertex and those of its colour that reach it back are a component, and the others go round again.
    """
    left, n = counted(edges.where("src != dst").select("src", "dst").distinct())
    done = left.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)
    while n:
        before = n
        # A vertex that only leaves or only enters is on no cycle.
        left, n = counted(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        if n < before:
            continue
        colour = left.select(F.col("src").alias("id")).distinct().withColumn("c", F.col("id"))
        while True:
            told = left.join(colour.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "c")
            new, changed = counted(colour.withColumnRenamed("c", "old").join(told.groupBy("id").agg(F.min("c").alias("c")), "id").where("c < old").select("id", "c"))
            if not changed:
                break
            colour = stored(colour.join(new.withColumnRenamed("c", "n"), "id", "left").select("id", F.least("c", "n").alias("c")))
        same = left.join(colour.select(F.col("id").alias("src"), F.col("c").alias("a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("b")), "dst").where("a = b")
        roots = colour.where("id = c").select(F.col("id").alias("root"), "id")
        found = stored(reach(same.select("src", "dst"), roots, reverse=True).select("id", F.col("root").alias("component")).union(roots.select("id", F.col("root").alias("component"))).distinct())
        done = done.union(found)
        taken = found.select("id")
        left, n = counted(left.join(taken.withColumnRenamed("id", "src"), "src", "left_anti").join(taken.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"))
    sizes = done.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    return done.join(sizes, "component", "left_semi").select("id", "component")


def condensed(edges: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(src, dst): the edges between components, which are named by their least vertices; an acyclic graph."""
    of = stored(components(edges)) if found is None else found
    name = lambda end: of.select(F.col("id").alias(end), F.col("component").alias(end[0]))
    out = edges.select("src", "dst").join(name("src"), "src", "left").join(name("dst"), "dst", "left")
    return out.select(F.coalesce("s", "src").alias("src"), F.coalesce("d", "dst").alias("dst")).where("src != dst").distinct()


def conditions_of(g: PropertyGraph, id: str) -> DataFrame:
    """(src, condition) of the edges with a condition into a vertex."""
    return g.edges.where((F.col("dst") == id) & (F.col("condition") != "")).select("src", "condition").distinct()


def unfinished(blocks: DataFrame, kind: str) -> DataFrame:
    """blocks (id, kind, has_else): if-blocks without an else, case-blocks without a default."""
    return blocks.where((F.col("kind") == kind) & ~F.col("has_else"))


def steering(blocks: DataFrame, control: list[str], data: list[str]) -> DataFrame:
    """blocks (id, variables: array): those with one of the control variables and one of the data variables."""
    return blocks.where(F.arrays_overlap("variables", F.array(*map(F.lit, control))) & F.arrays_overlap("variables", F.array(*map(F.lit, data))))


def dependent_conditions(conditions: DataFrame, name: str) -> DataFrame:
    """conditions (condition): those that a name stands in."""
    return conditions.where(F.array_contains(S.condition_signals(F.col("condition")), name))
