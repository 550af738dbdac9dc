"""Passes over a graph: each takes one and returns another, so they are chained with functools.reduce or by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import scalars as S
from ..graph import PropertyGraph

BITS = r"\[.*?\]"


def _with(g: PropertyGraph, vertices: DataFrame | None = None, edges: DataFrame | None = None) -> PropertyGraph:
    """g with more vertices (where an id is there already it stays) and edges."""
    v, e = g.vertices, g.edges
    if vertices is not None:
        new = schema.conform(vertices, schema.VERTICES).dropDuplicates(["id"])
        v = v.unionByName(new.join(v.select("id"), "id", "left_anti").select(*new.columns))
    if edges is not None:
        e = e.unionByName(schema.conform(edges, schema.EDGES).select(*e.columns))
    return PropertyGraph.of(v, e, placeholders=False)


def mark_special(g: PropertyGraph) -> PropertyGraph:
    """Clocks and resets by their names."""
    n = F.lower("name")
    return PropertyGraph(g.vertices.withColumn("is_clock", S.contains_any(n, ("clk", "clock"))).withColumn("is_reset", S.contains_any(n, ("rst", "reset"))), g.edges)


def upgrade_registers(g: PropertyGraph) -> PropertyGraph:
    """What a clock drives is a register, unless it is a part of a vector."""
    clocked = g.edges.where("kind = 'CLOCK'").select(F.col("dst").alias("id")).distinct().withColumn("clocked", F.lit(True))
    v = g.vertices.join(clocked, "id", "left")
    kind = F.when(F.col("clocked") & ~F.col("id").contains("["), "REG").otherwise(F.col("kind"))
    return PropertyGraph(v.withColumn("kind", kind).select(*g.vertices.columns), g.edges)


def bit_parents(g: PropertyGraph) -> PropertyGraph:
    """x[...] hangs under x by a BIT_SELECT edge; an x that isn't there is made."""
    parts = g.vertices.where(F.col("id").contains("[")).withColumn("parent", F.regexp_replace("id", BITS, ""))
    made = parts.select(F.col("parent").alias("id"), F.regexp_replace("name", BITS, "").alias("name"), "module")
    return _with(g, made, parts.select(F.col("id").alias("src"), F.col("parent").alias("dst"), F.lit("BIT_SELECT").alias("kind")))


def bit_spans(g: PropertyGraph) -> DataFrame:
    """(id, parent, msb, lsb, width) of the vertices that are a numbered part x[m:l] or x[i] of another."""
    r = S.bit_range(F.col("id"))
    out = g.vertices.select("id", r["name"].alias("parent"), F.greatest(r["msb"], r["lsb"]).alias("msb"), F.least(r["msb"], r["lsb"]).alias("lsb"))
    return out.where("msb is not null").withColumn("width", F.col("msb") - F.col("lsb") + 1)


def struct_members(g: PropertyGraph) -> DataFrame:
    """(struct, member): vertices that are another vertex's path and one segment more."""
    v = g.vertices.where(F.col("id").contains(".")).select(F.regexp_extract("id", r"^(.*)\.[^.]*$", 1).alias("struct"), F.substring_index("id", ".", -1).alias("member"))
    return v.join(g.vertices.select(F.col("id").alias("struct")), "struct", "left_semi")


def expand_structs(g: PropertyGraph, members: DataFrame | None = None) -> PropertyGraph:
    """Where a struct of two members or more drives a vertex, each of its members drives the vertex's member of that name;
    members that aren't there are made. Members hang under their structs by BIT_SELECT edges."""
    m = (struct_members(g) if members is None else members).distinct()
    big = m.groupBy("struct").agg(F.count("*").alias("n")).where("n > 1").select("struct")
    m = m.join(big, "struct", "left_semi")
    whole = g.top_edges().where("kind = 'DRIVER'").select(F.col("src").alias("struct"), "dst", "assign_type")
    e = whole.join(m, "struct").select(F.concat_ws(".", "struct", "member").alias("src"), F.concat_ws(".", "dst", "member").alias("to"), "assign_type", F.concat_ws(".", "struct", "member").alias("expression"), F.col("dst").alias("of"), "member")
    mod = g.vertices.select(F.col("id").alias("of"), "module", "width_msb", "width_lsb")
    made = e.join(mod, "of").select(F.col("to").alias("id"), F.col("member").alias("name"), "module", "width_msb", "width_lsb")
    up = m.select(F.concat_ws(".", "struct", "member").alias("src"), F.col("struct").alias("dst"), F.col("member").alias("expression"))
    up = up.union(e.select(F.col("to"), F.col("of"), "member")).distinct().withColumn("kind", F.lit("BIT_SELECT")).withColumn("assign_type", F.lit("internal"))
    return _with(_with(g, made, e.select("src", F.col("to").alias("dst"), "assign_type", "expression")), None, up)


def under(g: PropertyGraph, targets: list[str]) -> PropertyGraph:
    """The graph of what lies under the paths of targets, with ids of one segment and numbers."""
    near = ~F.col("id").contains(".") | S.is_literal(F.col("id"))
    for t in targets:
        near = near | (F.col("id") == t) | F.col("id").startswith(t + ".")
    v = g.vertices.where(near)
    ends = v.select("id")
    e = g.edges.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return PropertyGraph(v, e.select(*g.edges.columns))


def passthroughs(g: PropertyGraph, instances: DataFrame) -> PropertyGraph:
    """Ports of instances that nothing drives, of wrappers around others: an input port drives the ports of its name in the
    instances below, an output port is driven by them, unless a driver is there already. Paths are met by their ends as keys."""
    ports = g.vertices.where("kind in ('PORT_IN', 'PORT_OUT')").select("id", "kind", F.substring_index("id", ".", -1).alias("port"), F.regexp_extract("id", r"^(.*)\.[^.]*$", 1).alias("inst"))
    ports = ports.join(instances.select(F.col("id").alias("inst")), "inst", "left_semi")
    driven = g.edges.where("kind = 'DRIVER'").select(F.col("dst").alias("id")).distinct()
    bare = ports.join(driven, "id", "left_anti")
    p = F.split("inst", r"\.")
    outer = F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.array_join(F.slice(p, 1, i), "."))
    inner = ports.where(F.size(p) > 1).select(F.col("id").alias("deep"), "port", F.col("kind").alias("deep_kind"), F.explode(outer).alias("inst"))
    met = bare.join(inner, ["inst", "port"]).where("kind = deep_kind")
    src, dst = F.when(F.col("kind") == "PORT_IN", F.col("id")).otherwise(F.col("deep")), F.when(F.col("kind") == "PORT_IN", F.col("deep")).otherwise(F.col("id"))
    new = met.select(src.alias("src"), dst.alias("dst")).distinct().join(g.edges.where("kind = 'DRIVER'").select("src", "dst"), ["src", "dst"], "left_anti")
    return _with(g, None, new.withColumn("kind", F.lit("DRIVER")).withColumn("assign_type", F.lit("connection")))


def filled(vertices: DataFrame, symbols: DataFrame) -> DataFrame:
    """vertices (id, file, line, ...) with the file and line of symbols (id, file, line) where theirs is absent."""
    s = symbols.groupBy("id").agg(F.min(F.struct("file", "line")).alias("s"))
    gone = (F.coalesce("file", F.lit("")) == "") & F.col("s").isNotNull()
    out = vertices.join(s, "id", "left")
    return out.select(*[F.when(gone, F.col(f"s.{c}")).otherwise(F.col(c)).alias(c) if c in ("file", "line") else F.col(c) for c in vertices.columns])


def with_directions(vertices: DataFrame, modports: DataFrame) -> DataFrame:
    """vertices with modport_dir of modports (id, modport_dir), '' where there is none."""
    m = modports.groupBy("id").agg(F.min("modport_dir").alias("modport_dir"))
    return vertices.drop("modport_dir").join(m, "id", "left").na.fill("", ["modport_dir"])
