"""The property graph: two DataFrames, and what is stored, added, chosen and looked up in them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import schema
from .storage import parts, placed, stored
from .functions import scalars as S

DEDUP = ("src", "dst", "kind", "condition", "assign_type", "expression")


@dataclass(frozen=True)
class PropertyGraph:
    """vertices (key id) and edges (several rows for a pair may be parallel edges); every method returns a new value."""

    vertices: DataFrame
    edges: DataFrame
    memo: dict[str, DataFrame] = field(default_factory=dict, compare=False, repr=False)
    #: Vertices lie in so many buckets of their ids, edges in as many of dst (0: they lie anyhow).
    buckets: int = 0

    def kept(self, name: str, make: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
        """A table that is derived from the whole graph, written when it is first asked for. by: a column that it lies in buckets of,
        as the graph's own tables do; make() is to have it in as many partitions of it."""
        if name not in self.memo:
            self.memo[name] = placed(make(), by, self.buckets)[0] if by and self.buckets else stored(make())
        return self.memo[name]

    def materialised(self, rows: int | None = None) -> PropertyGraph:
        """The graph with its tables written once: vertices in buckets of their ids, edges in as many of their ends, sorted by kind
        and source. What joins or groups by vertices and ends of edges then shuffles neither. rows: about how many edges there are,
        counted if not given; edges that lie in parts(rows) partitions of dst are written where they are."""
        n = parts(self.edges.sparkSession, self.edges.count() if rows is None else rows)
        vertices, _ = placed(self.vertices.repartition(n, "id"), "id", n, order=("id",))
        edges, _ = placed(self.edges if rows is not None else self.edges.repartition(n, "dst"), "dst", n, order=("kind", "src"))
        return PropertyGraph(vertices, edges, buckets=n)

    def parted(self, df: DataFrame, by: str) -> DataFrame:
        """df in as many partitions of a column as the graph's tables have buckets."""
        return df.repartition(self.buckets, by) if self.buckets else df

    @staticmethod
    def of(vertices: DataFrame, edges: DataFrame, placeholders: bool = True) -> PropertyGraph:
        """A graph of rows: absent columns get defaults, repeated edges go, ends without a vertex get one."""
        g = PropertyGraph(schema.conform(vertices, schema.VERTICES), deduplicated(schema.conform(edges, schema.EDGES)))
        return PropertyGraph(g.vertices.unionByName(g.placeholders()), g.edges) if placeholders else g

    def placeholders(self) -> DataFrame:
        """Vertices for ends that have none: CONST for literals, else SIGNAL, in the module of the id's first segment and
        named by all that follows it."""
        ends = self.edges.select(F.col("src").alias("id")).union(self.edges.select("dst")).distinct()
        new = ends.join(self.vertices.select("id"), "id", "left_anti")
        literal = S.is_literal(F.col("id"))
        name = F.when(literal | ~F.col("id").contains("."), F.col("id")).otherwise(F.regexp_replace("id", r"^[^.]*\.", ""))
        return schema.conform(new.select("id", name.alias("name"), F.when(literal, "").otherwise(F.substring_index("id", ".", 1)).alias("module"), F.when(literal, "CONST").otherwise("SIGNAL").alias("kind")), schema.VERTICES)

    def upsert(self, vertices: DataFrame) -> PropertyGraph:
        """Adds vertices; where an id is there already the new row replaces it. Ids in `vertices` must be unique."""
        new = schema.conform(vertices, schema.VERTICES)
        return PropertyGraph(self.vertices.join(new.select("id"), "id", "left_anti").select(*self.vertices.columns).unionByName(new), self.edges)

    def add_edges(self, edges: DataFrame) -> PropertyGraph:
        return PropertyGraph.of(self.vertices, self.edges.unionByName(schema.conform(edges, schema.EDGES)))

    def node(self, id: str) -> DataFrame:
        return self.vertices.where(F.col("id") == id)

    def edges_between(self, src: str, dst: str, states: tuple[str, ...] = ()) -> DataFrame:
        return self.edges.where((F.col("src") == src) & (F.col("dst") == dst)).orderBy(*priority(states))

    def top_edges(self, states: tuple[str, ...] = ()) -> DataFrame:
        """The edge of highest priority of each pair, by one combined aggregate rather than a sort of each pair."""
        return self.kept(f"top {states}", lambda: self._top(self.edges, states), "dst")

    def top_into(self, ends: DataFrame) -> DataFrame:
        """The top_edges() into some vertices (id). Unless all have been made, those into others aren't."""
        if "top ()" in self.memo:
            return self.memo["top ()"].join(ends.select(F.col("id").alias("dst")), "dst", "left_semi").select(*self.edges.columns)
        return self._top(self.edges.join(ends.select(F.col("id").alias("dst")), "dst", "left_semi").select(*self.edges.columns), ())

    def _top(self, edges: DataFrame, states: tuple[str, ...]) -> DataFrame:
        cols = [c for c in edges.columns if c not in ("src", "dst")]
        key = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(priority(states))], *[F.col(c) for c in cols])
        return edges.groupBy("src", "dst").agg(F.min(key).alias("e")).select("src", "dst", *[F.col(f"e.{c}").alias(c) for c in cols])

    def degrees(self) -> DataFrame:
        """(id, fan_in, fan_out) over distinct pairs, for every vertex."""
        return self.kept("degrees", self._degrees, "id")

    def pairs(self) -> DataFrame:
        """(src, dst), each once."""
        if "top ()" in self.memo or not self.buckets:
            return self.top_edges().select("src", "dst")
        return self.edges.select("src", "dst").distinct()  # within its bucket: nothing is shuffled or written

    def _degrees(self) -> DataFrame:
        pairs = self.pairs()
        into = pairs.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in"))
        out = self.parted(pairs.select(F.col("src").alias("id")), "id").groupBy("id").agg(F.count("*").alias("fan_out"))
        return self.vertices.select("id").join(into, "id", "left").join(out, "id", "left").na.fill(0, ["fan_in", "fan_out"])


def deduplicated(edges: DataFrame) -> DataFrame:
    """The first (by edge_seq, then clock) of edges that are equal in the deduplication key."""
    rest = [c for c in edges.columns if c not in DEDUP]
    first = F.min(F.struct("edge_seq", "clock_domain", *[c for c in rest if c not in ("edge_seq", "clock_domain")])).alias("f")
    return edges.groupBy(*DEDUP).agg(first).select(*[F.col(f"f.{c}").alias(c) if c in rest else F.col(c) for c in edges.columns])


def priority(states: tuple[str, ...] = ()) -> list[Column]:
    """Order of parallel edges: pure reset conditions, then by the state asked for (later in `states` first, none last),
    then shorter conditions, then text; ties by edge_seq and clock."""
    c = F.col("condition")
    reset = S.is_reset_condition(c)
    state = F.when(~reset, F.regexp_extract(c, r"state\s*(?:===|==)\s*(\w+)", 1))
    rank = F.coalesce(F.lit(None).cast("int"), F.lit(len(states)))  # a bare number would be taken for a column's place
    for i, s in enumerate(states):
        rank = F.when(state == s, len(states) - i).otherwise(rank)
    return [(~reset).alias("not_reset"), rank, F.length(c), c, F.col("edge_seq"), F.col("clock_domain")]
