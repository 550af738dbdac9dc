"""The prefix trie of conversations, its sums by heavy-path decomposition.

A node is a sequence of turns that conversations begin with. Its key is the exclusive or of two 64-bit hashes of (turn's
SHA-256, place) over the sequence, a running value that tasks can carry on from one another, so that a conversation of any
length is spread over tasks. That no two sequences share a key is checked: all rows of a key must have one parent key, one
turn and one depth, which by induction from the root makes the sequence one; otherwise the job fails rather than err.

The heavy child of a node is the one with most members (ties by key); a path is a chain of heavy children down to a leaf, so
all of it are prefixes of the leaf's first conversation, and where it begins is the last node on that conversation that is no
heavy child: an aggregate, not a walk. A light node has at most half of its parent's members, so a leaf has at most log2 of
the members light nodes above it. Paths are arrays in blocks of BLOCK nodes; those with most light nodes above them go first,
get suffix sums along their arrays and send the sum at their head to the node they hang from.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, written
from .scan import scanned

#: Nodes of a path in one array; ids that are joined into one piece of text before they are hashed.
BLOCK, PIECE = 1024, 4096
NODE = ["x1", "x2"]


def turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, n_, dig, size): a conversation's turns by number (null first; ties by the SHA-256 of the turn), numbered from 1; dig:
    SHA-256 of role and text (null: empty), size: bytes of the text. Rows without a conversation's id take no part; repeated
    rows are turns of their own; other columns go."""
    text, role = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (text_col, role_col))
    dig = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    out = df.select(F.col(f"`{conv_col}`").cast("bigint").alias("c"), F.col(f"`{turn_col}`").alias("turn"), dig.alias("dig"), F.octet_length(text).cast("bigint").alias("size"))
    return scanned(out.where("c is not null"), "c", ["turn", "dig"], "turns").select("c", "n_", "dig", "size")


def rebuilt(turns: DataFrame, base: Column, heads: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """turns() → conversations (c, total), and their turns (c, pos, dig, size, total), where each conversation begins with the
    first `heads` (at most `most`) turns of conversation `base`, as far as there are, and goes on with its own turns behind its
    first `heads`. base and heads are expressions of c; a conversation of which nothing is left has total 0."""
    first = turns.where(F.col("n_") <= most).groupBy(F.col("c").alias("b_")).agg(F.array_sort(F.collect_list(F.struct("n_", "dig", "size"))).alias("first"))
    convs = turns.groupBy("c").agg(F.max("n_").alias("own")).withColumn("h", heads.cast("int")).withColumn("b_", base)
    convs = convs.join(first, "b_", "left").select("c", "h", "own", F.coalesce(F.slice("first", F.lit(1), F.col("h")), F.expr("array()").cast(first.schema["first"].dataType)).alias("first"))
    total = F.size("first") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    convs = written(convs.withColumn("total", total.cast("bigint")), "convs")
    taken = convs.select("c", F.explode("first").alias("t"), "total").select("c", F.col("t.n_").alias("pos"), "t.dig", "t.size", "total")
    kept = turns.where(F.col("n_") > heads).join(convs.select("c", "h", F.size("first").alias("k"), "total"), "c")
    kept = kept.select("c", (F.col("n_") - F.col("h") + F.col("k")).alias("pos"), "dig", "size", "total")
    return convs.select("c", "total"), taken.unionByName(kept)


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """convs (c, total) and turns (c, pos from 1, dig, size, total) → a row for each distinct beginning: conv_id (its smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 and n_ends (members that end
    here). Without conversations there is no root and no row."""
    words = turns.withColumn("w1", F.xxhash64("dig", "pos")).withColumn("w2", F.xxhash64(F.lit("other"), "pos", "dig"))
    chain = scanned(words, "c", ["pos"], "chain", ("w1", "w2"))
    chain = chain.select("c", "pos", "size", "total", "dig", F.col("w1_").alias("x1"), F.col("w2_").alias("x2"), F.col("w1_").bitwiseXOR(F.col("w1")).alias("p1"), F.col("w2_").bitwiseXOR(F.col("w2")).alias("p2"))
    nodes = written(_nodes(convs, chain), "nodes")
    tree, levels = _paths(chain, nodes)
    sums = _summed(tree, levels)
    above = nodes.select(F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, NODE).join(_ends(convs, chain), NODE, "left").join(above, ["p1", "p2"], "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"), F.coalesce("n_ends", F.lit(0)).alias("n_ends"))


def _nodes(convs: DataFrame, chain: DataFrame) -> DataFrame:
    """(x1, x2, p1, p2, depth, conv_id, n_convs, size, n_children, heavy)."""
    same = F.struct("p1", "p2", "pos", "dig")
    nodes = chain.groupBy(*NODE).agg(F.min(same).alias("a"), F.max(same).alias("z"), F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.max("size").alias("size"))
    sure = F.when((F.col("a") == F.col("z")) & ~((F.col("x1") == 0) & (F.col("x2") == 0)), F.col("conv_id")).otherwise(F.raise_error(F.lit("trie: two beginnings have one key")).cast("bigint"))
    nodes = nodes.select(*NODE, "a.p1", "a.p2", F.col("a.pos").alias("depth"), sure.alias("conv_id"), "n_convs", "size")
    root = convs.agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    root = root.select(zero.alias("x1"), zero.alias("x2"), none.alias("p1"), none.alias("p2"), zero.alias("depth"), "conv_id", "n_convs", zero.alias("size"))
    nodes = written(nodes.unionByName(root), "nodes")
    below = nodes.where("depth > 0").groupBy("p1", "p2").agg(F.count("*").alias("n_children"), F.max(F.struct("n_convs", *NODE)).alias("h"))
    below = written(below, "children")
    counts = below.select(F.col("p1").alias("x1"), F.col("p2").alias("x2"), "n_children")
    heavy = below.select("h.x1", "h.x2", F.lit(True).alias("heavy"))
    out = nodes.join(counts, NODE, "left").join(heavy, NODE, "left")
    return out.withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("heavy", F.coalesce("heavy", F.lit(False)))


def _paths(chain: DataFrame, nodes: DataFrame) -> tuple[DataFrame, int]:
    """A row for each node: path (the conversation of its leaf), pos, level (light nodes above the path's head, its own
    included), head (whether it is one), the node and its parent, and its own part of the sums; and the number of levels."""
    leaves = nodes.where("n_children = 0").select(F.col("conv_id").alias("c"))
    mine = written(chain.join(leaves, "c", "left_semi").select("c", "pos", *NODE), "leaf-chains")
    light = nodes.where("depth > 0 and not heavy").select(*NODE)
    heads = mine.join(light, NODE).groupBy("c").agg(F.max("pos").alias("head_"), F.count("*").alias("level"))
    paths = written(leaves.join(heads, "c", "left").na.fill(0, ["head_", "level"]), "paths")
    zero = F.lit(0).cast("bigint")
    on = mine.join(paths, "c").where("pos >= head_").select(F.col("c").alias("path"), "pos", "level", "head_", *NODE)
    on = on.unionByName(paths.where("head_ = 0").select(F.col("c").alias("path"), zero.alias("pos"), "level", "head_", zero.alias("x1"), zero.alias("x2")))
    own = nodes.select(*NODE, "p1", "p2", (F.col("n_children") == 0).cast("bigint").alias("leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    tree = on.join(own, NODE).select("path", "pos", "level", (F.col("pos") == F.col("head_")).alias("head"), *NODE, "p1", "p2", "leaves", "saved")
    tree = written(tree, "tree")
    most = tree.agg(F.max("level")).first()[0]
    return tree, -1 if most is None else int(most)


def _summed(tree: DataFrame, levels: int) -> DataFrame:
    """(x1, x2, n_leaves, saved_tokens): sums over the subtree of each node."""
    spark, done = tree.sparkSession, None
    ship(spark)
    light = None
    for level in range(levels, -1, -1):
        rows = tree.where(F.col("level") == level)
        if light is not None:
            rows = rows.join(light, NODE, "left").withColumn("leaves", F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("more_saved", F.lit(0)))
        arrays = rows.groupBy("path", F.floor(F.col("pos") / BLOCK).cast("bigint").alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "head", *NODE, "p1", "p2", "leaves", "saved"))).alias("nodes"))
        blocks = written(arrays.mapInArrow(_suffix_sums, f"path bigint, block bigint, nodes {arrays.schema['nodes'].dataType.simpleString()}, leaves bigint, saved bigint"), "blocks")
        after = Window.partitionBy("path").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
        rest = blocks.select("path", "block", F.sum("leaves").over(after).alias("rest_leaves"), F.sum("saved").over(after).alias("rest_saved"))
        whole = blocks.select("path", "block", F.explode("nodes").alias("n")).join(rest.where("rest_leaves is not null"), ["path", "block"], "left")
        total = lambda c: (F.col(f"n.{c}") + F.coalesce(f"rest_{c}", F.lit(0)))
        out = written(whole.select("n.head", "n.x1", "n.x2", "n.p1", "n.p2", total("leaves").alias("n_leaves"), total("saved").alias("saved_tokens")), "sums")
        heads = out.where("head and p1 is not null").groupBy(F.col("p1").alias("x1"), F.col("p2").alias("x2"))
        light = heads.agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        out = out.select(*NODE, "n_leaves", "saved_tokens")
        done = out if done is None else done.unionByName(out)
    return done if done is not None else tree.select(*NODE, F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def _suffix_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (path, block, nodes), with the sums from each node to its block's end in place of its own, and the block's sums."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column(2)
        flat, ends = lists.flatten(), np.cumsum(np.asarray(lists.value_lengths()))
        cols = {f.name: flat.field(i) for i, f in enumerate(flat.type)}
        first, sums = np.concatenate(([0], ends[:-1])), []
        for name in ("leaves", "saved"):
            x = cols[name].to_numpy(zero_copy_only=False)
            before = np.concatenate(([0], np.cumsum(x)))
            suffix = np.repeat(before[ends], ends - first) - before[:-1]
            cols[name] = pa.array(suffix, pa.int64())
            sums.append(pa.array(suffix[first], pa.int64()))
        made = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.StructArray.from_arrays(list(cols.values()), names=list(cols)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made, *sums], names=["path", "block", "nodes", "leaves", "saved"])


def _ends(convs: DataFrame, chain: DataFrame) -> DataFrame:
    """(x1, x2, ends_sha256, n_ends): ids of the conversations that end at a node, sorted over all tasks, joined into pieces
    where they lie, and the pieces hashed in their order as they pass: a node's ids are never held together."""
    zero = F.lit(0).cast("bigint")
    ends = chain.where(F.col("pos") == F.col("total")).select(*NODE, "c").unionByName(convs.where("total = 0").select(zero.alias("x1"), zero.alias("x2"), "c"))
    tasks = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x1, x2, c = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            new = np.concatenate(([True], (x1[1:] != x1[:-1]) | (x2[1:] != x2[:-1])))
            place = np.arange(len(c)) - np.maximum.accumulate(np.where(new, np.arange(len(c)), 0))
            starts = np.flatnonzero(place % PIECE == 0)
            text = [",".join(map(str, c[a:b].tolist())) for a, b in zip(starts, [*starts[1:], len(c)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x1[starts]), pa.array(x2[starts]), pa.array(c[starts]), pa.array(np.diff([*starts, len(c)]), pa.int64()), pa.array(text)], names=[*NODE, "first", "n", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, n, out = None, None, 0, []
        for batch in batches:
            for x1, x2, _, k, ids in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if now == (x1, x2):
                    sha.update(b"," + ids.encode())
                    n += k
                    continue
                if now is not None:
                    out.append((*now, sha.hexdigest(), n))
                now, sha, n = (x1, x2), hashlib.sha256(ids.encode()), k
            if len(out) > 10_000:
                yield _rows(out)
                out = []
        yield _rows(out + [(*now, sha.hexdigest(), n)] if now is not None else out)

    parts = ends.repartitionByRange(tasks, *NODE, "c").sortWithinPartitions(*NODE, "c").mapInArrow(pieces, "x1 bigint, x2 bigint, first bigint, n bigint, ids string")
    return parts.repartition(tasks, *NODE).sortWithinPartitions(*NODE, "first").mapInArrow(hashed, "x1 bigint, x2 bigint, ends_sha256 string, n_ends bigint")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (("x1", pa.int64()), ("x2", pa.int64()), ("ends_sha256", pa.string()), ("n_ends", pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, (_, k) in enumerate(kinds)], names=[c for c, _ in kinds])
