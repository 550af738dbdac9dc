"""Instances and their ports: what a signal is called on the other side of an instance, and what is below a module.

instances (id, module_type, parent); ports (inst_port, instance, internal): an instance's port and the signal that it is inside.
A signal may be many instances' port; every one is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from .paths import shortest_path
from .traverse import fan_in, fan_out, reach


def internal(ports: DataFrame, ids: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """ids (id) → (id, internal): the signal inside a port, from the instance map `own` if that has it, else from ports."""
    m = ports.select(F.col("inst_port").alias("id"), F.col("internal").alias("i"))
    if own is None:
        return ids.select("id").join(m, "id").select("id", F.col("i").alias("internal")).distinct()
    first = own.select(F.col("inst_port").alias("id"), F.col("internal").alias("o"))
    return ids.select("id").join(first, "id", "left").join(m, "id", "left").select("id", F.coalesce("o", "i").alias("internal")).where("internal is not null").distinct()


def port_paths(ports: DataFrame, ids: DataFrame) -> DataFrame:
    """ids (id) → (id, inst_port) of every instance port that is this signal inside."""
    return ids.select("id").join(ports.select(F.col("internal").alias("id"), "inst_port"), "id").distinct()


def children(instances: DataFrame, parent: str) -> DataFrame:
    return instances.where(F.col("parent") == parent)


def distinct_instances(instances: DataFrame, parent: str | None = None) -> DataFrame:
    """Each instance once, by its path (of several rows the least); of one parent if it is named."""
    rest = [c for c in instances.columns if c != "id"]
    out = instances.groupBy("id").agg(F.min(F.struct(*rest)).alias("r")).select("id", *[F.col(f"r.{c}").alias(c) for c in rest])
    return out if parent is None else out.where(F.col("parent") == parent)


def below(instances: DataFrame, module: str, depth: int = 1) -> DataFrame:
    """(id, level) of the instances at most `depth` levels below a module's or an instance's own."""
    steps = instances.select(F.col("parent").alias("src"), F.col("id").alias("dst")).where("src is not null")
    start = instances.sparkSession.createDataFrame([(module, module)], "root string, id string")
    return reach(steps, start, depth).select("id", "level")


def collapsed(instances: DataFrame, most: int) -> DataFrame:
    """(id, module_type, n): the first instance of each of the `most` most frequent module types, with how many there are."""
    per = instances.groupBy("module_type").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    return per.orderBy(F.desc("n"), "module_type").limit(most).select("id", "module_type", "n")


def not_extracted(ports: DataFrame, found: DataFrame) -> DataFrame:
    """(n, first: at most 20 in order) of the instances that have ports but are not in found (id)."""
    gone = ports.select(F.col("instance").alias("id")).distinct().join(found.select("id"), "id", "left_anti")
    first = gone.orderBy("id").limit(20).agg(F.array_sort(F.collect_list("id")).alias("first"))
    return gone.agg(F.count("*").alias("n")).join(first)


def resolve(ports: DataFrame, signals: DataFrame) -> DataFrame:
    """signals (id) → (id, to): what is inside a port; or itself, if something is it inside; or what is inside the first port
    whose path ends in it; or itself. Ends of paths are keys of their own, so nothing is compared with every port."""
    exact = ports.groupBy(F.col("inst_port").alias("id")).agg(F.min("internal").alias("exact"))
    inside = ports.select(F.col("internal").alias("id")).distinct().withColumn("inside", F.col("id"))
    parts = F.split("inst_port", r"\.")
    ends = F.transform(F.sequence(F.lit(2), F.size("p")), lambda i: F.array_join(F.slice("p", i, F.size("p")), "."))
    tails = ports.select("inst_port", "internal", parts.alias("p")).where(F.size("p") > 1).select(F.explode(ends).alias("id"), F.struct("inst_port", "internal").alias("m"))
    tails = tails.groupBy("id").agg(F.min("m").alias("m")).select("id", F.col("m.internal").alias("tail"))
    out = signals.select("id").distinct().join(exact, "id", "left").join(inside, "id", "left").join(tails, "id", "left")
    return out.select("id", F.coalesce("exact", "inside", "tail", "id").alias("to"))


def twin_loads(ports: DataFrame, starts: DataFrame) -> DataFrame:
    """starts (root, id) → (root, id): the signal inside a port, and the instance ports of a signal."""
    a = starts.join(ports.select(F.col("inst_port").alias("id"), F.col("internal").alias("to")), "id").where("to != id")
    b = starts.join(ports.select(F.col("internal").alias("id"), F.col("inst_port").alias("to")), "id").where("to != id")
    return a.select("root", F.col("to").alias("id")).union(b.select("root", F.col("to").alias("id"))).distinct()


def twin_drivers(ports: DataFrame, starts: DataFrame) -> DataFrame:
    """starts (root, id) → (root, id): the signal inside a port, and the other instance ports that are it inside."""
    inner = starts.join(ports.select(F.col("inst_port").alias("id"), F.col("internal").alias("to")), "id").where("to != id").select("root", "id", "to")
    others = inner.join(ports.select(F.col("internal").alias("to"), "inst_port"), "to").where("inst_port != id")
    return inner.select("root", F.col("to").alias("id")).union(others.select("root", F.col("inst_port").alias("id"))).distinct()


def _or_twins(found: DataFrame, starts: DataFrame, twins: DataFrame) -> DataFrame:
    none = starts.join(found.select("root").distinct(), "root", "left_anti")
    return found.select("root", "id").union(twins.join(none.select("root").distinct(), "root", "left_semi").select("root", "id"))


def loads(g: PropertyGraph, ports: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """fan_out() of starts (root, id), and what twin_loads() knows of those that have none."""
    return _or_twins(fan_out(g, starts, depth), starts, twin_loads(ports, starts))


def drivers(g: PropertyGraph, ports: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """fan_in() of starts (root, id), and what twin_drivers() knows of those that have none."""
    return _or_twins(fan_in(g, starts, depth), starts, twin_drivers(ports, starts))


def connection(g: PropertyGraph, ports: DataFrame, src: str, dst: str, most: int | None = None) -> DataFrame:
    """(path): a shortest path between two signals over edges either way and from ports to what they are inside."""
    one = g.pairs()
    jumps = ports.select(F.col("inst_port").alias("src"), F.col("internal").alias("dst"))
    both = one.union(one.select("dst", "src")).union(jumps).union(jumps.select("dst", "src"))
    return shortest_path(both.where("src != dst").distinct(), src, dst, most)


def clock_nets(g: PropertyGraph, ports: DataFrame, names: tuple[str, ...] = ("clk", "clock", "clk_i", "clk_p", "clk_n")) -> DataFrame:
    """(domain, id): the signals of each clock of the top level (at most two segments), by its short name, and of all that it
    is across instances, by the port map either way."""
    short = F.lower(F.substring_index("id", ".", -1))
    top = g.vertices.where((F.col("is_clock") | short.isin(*names)) & (F.size(F.split("id", r"\.")) <= 2))
    starts = top.select(F.concat(F.lit("domain."), short).alias("root"), "id")
    steps = ports.select(F.col("inst_port").alias("src"), F.col("internal").alias("dst"))
    found = reach(steps.union(steps.select("dst", "src")).distinct(), starts)
    return starts.union(found.select("root", "id")).distinct().withColumnRenamed("root", "domain")


def paired_by_base(names: DataFrame, most: int | None = None) -> DataFrame:
    """names (id, base, role) → (valid, ready): of each base the first valid with the first ready, the second with the second,
    in order of ids; at most `most` pairs in order."""
    rank = F.row_number().over(Window.partitionBy("base", "role").orderBy("id"))
    x = names.withColumn("k", rank)
    out = x.where("role = 'ready'").select("base", "k", F.col("id").alias("ready")).join(x.where("role = 'valid'").select("base", "k", F.col("id").alias("valid")), ["base", "k"]).select("valid", "ready")
    return out if most is None else out.orderBy("ready", "valid").limit(most)
