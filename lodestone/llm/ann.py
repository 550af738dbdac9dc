"""Nearest neighbours by learned partitions.

A bounded sample (SAMPLE distinct vectors, by hash) is searched against itself for a neighbour graph; the graph is halved
again and again into balanced parts that cut few of its edges, and a small classifier (one hidden layer) learns, from a
vector, in which parts its neighbours are. Every row is indexed under its most probable part. A query goes to its most
probable parts, as many as hold MASS of its probability, so that where parts say little about neighbours more are searched;
there it meets every row, in blocks, and the best are scored again on the original vectors in double precision.

Equal vectors are searched once: of those that stand in the index the k + 1 smallest ids of each vector can be in a result
(one may be the query's own), and the others can't. Parts of any size are cut into blocks, so a crowded part is many tasks.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, written

#: Distinct vectors that the index is fitted on at most (about: they are chosen by hash), and neighbours of each in the graph.
SAMPLE, NEAR = 16_384, 10
#: Rows that a part should have, and the most parts; beyond, parts grow and have more blocks.
PART_ROWS, MOST_PARTS = 4096, 256
#: Probability that the parts a query goes to hold together.
MASS = 0.97
#: Rows and queries of a block.
BLOCK, QUERIES = 8192, 1024
#: Width of the classifier's hidden layer, passes over the sample, and rows of a step.
HIDDEN, PASSES, STEP = 128, 40, 256


def vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v: the vector as little-endian doubles, padded with zeros to the longest). Null vectors, zero ones and those with
    a null or non-finite component go; a null id stays; other columns go. Components are cast to doubles, which is exact."""
    spark = df.sparkSession
    ship(spark)
    x = F.col(f"`{vector_col}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), x.alias("x"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = rows.where(F.col("x").isNotNull() & fine & F.exists("x", lambda v: v != 0))
    size = rows.agg(F.max(F.size("x"))).first()[0] or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            lens, flat = np.asarray(lists.value_lengths()), lists.flatten().to_numpy(zero_copy_only=False)
            out = np.zeros((len(lens), size))
            out[np.arange(size) < lens[:, None]] = flat + 0.0  # no negative zeros
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(out)], names=["id", "v"])

    return rows.mapInArrow(run, "id bigint, v binary")


def _binary(x: np.ndarray) -> pa.Array:
    """Rows of x as binary values."""
    width = x.shape[1] * x.itemsize
    raw = np.ascontiguousarray(x).tobytes()
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, (len(x) + 1) * width, width or 1, dtype=np.int32)[: len(x) + 1].tobytes()), pa.py_buffer(raw)])


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, size)


def graph(sample: np.ndarray, rows: np.ndarray, places: np.ndarray, near: int) -> np.ndarray:
    """Places in the sample of the `near` others with the largest inner product with each of rows, which are at places."""
    s = rows.astype(np.float32) @ sample.astype(np.float32).T
    s[np.arange(len(rows)), places] = -np.inf
    return np.argpartition(-s, near - 1, axis=1)[:, :near]


def balanced(near: np.ndarray, parts: int, rounds: int = 40, seed: int = 7) -> np.ndarray:
    """Part (0 ... parts - 1) of each node of a graph (near: neighbours of each), of equal sizes but for one: each set is split
    in proportion along its smoothest vector, by power iteration, then pairs of nodes that gain change sides."""
    n, r = len(near), np.random.default_rng(seed)
    out = np.zeros(n, np.int64)
    a, b = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    a, b = np.concatenate((a, b)), np.concatenate((b, a))
    todo = [(np.arange(n), 0, parts)]
    place = np.full(n, -1)
    while todo:
        nodes, first, k = todo.pop()
        if k == 1 or len(nodes) < 2:
            out[nodes] = first
            continue
        place[:] = -1
        place[nodes] = np.arange(len(nodes))
        inside = (place[a] >= 0) & (place[b] >= 0)
        i, j = place[a[inside]], place[b[inside]]
        degree = np.bincount(i, minlength=len(nodes)) + 1.0
        root = np.sqrt(degree)
        x, flat = r.standard_normal(len(nodes)), root / np.linalg.norm(root)
        for _ in range(rounds):
            x = x - flat * (flat @ x)
            y = x / root
            x = 0.5 * x + 0.5 * (np.bincount(i, y[j], len(nodes)) + y) / root
            x /= np.linalg.norm(x) + 1e-300
        left = k // 2
        cut = round(len(nodes) * left / k)
        side = np.ones(len(nodes), np.int8)
        side[np.argsort(x / root, kind="stable")[:cut]] = 0
        side = _swapped(i, j, side)
        todo += [(nodes[side == 0], first, left), (nodes[side == 1], first + left, k - left)]
    return out


def _swapped(i: np.ndarray, j: np.ndarray, side: np.ndarray, rounds: int = 12) -> np.ndarray:
    cut = lambda s: int((s[i] != s[j]).sum())
    now, share = cut(side), 0.5
    for _ in range(rounds):
        gain = np.bincount(i, np.where(side[i] != side[j], 1, -1), len(side))
        zero, one = (np.flatnonzero(side == s) for s in (0, 1))
        zero, one = zero[np.argsort(-gain[zero], kind="stable")], one[np.argsort(-gain[one], kind="stable")]
        m = min(len(zero), len(one))
        pairs = int((gain[zero[:m]] + gain[one[:m]] > 0).sum())
        pairs = max(1, int(pairs * share)) if pairs else 0
        if not pairs:
            break
        new = side.copy()
        new[zero[:pairs]], new[one[:pairs]] = 1, 0
        if (c := cut(new)) < now:
            side, now = new, c
        else:
            share /= 2
    return side


@dataclass
class Router:
    """The classifier: probabilities of parts from vectors."""

    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(x.astype(np.float32) * np.float32(self.scale) @ self.w1 + self.b1, 0)
        z = h @ self.w2 + self.b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, scale=self.scale, w1=self.w1, b1=self.b1, w2=self.w2, b2=self.b2)
        return out.getvalue()

    @staticmethod
    def load(raw: bytes) -> Router:
        z = np.load(io.BytesIO(raw))
        return Router(float(z["scale"]), z["w1"], z["b1"], z["w2"], z["b2"])


def learned(x: np.ndarray, near: np.ndarray, part: np.ndarray, parts: int, seed: int = 11) -> Router:
    """The classifier of which parts a vector's neighbours (and it itself) are in, by Adam on cross-entropy."""
    r = np.random.default_rng(seed)
    soft = np.zeros((len(x), parts), np.float32)
    np.add.at(soft, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 1)
    soft[np.arange(len(x)), part] += 1
    soft /= soft.sum(axis=1, keepdims=True)
    scale = np.sqrt(x.shape[1]) / max(float(np.sqrt((x * x).sum(axis=1)).mean()), 1e-300)
    x = (x * scale).astype(np.float32)
    w = [r.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), r.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    w = [v.astype(np.float32) for v in w]
    m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    t, all_steps = 0, PASSES * -(-len(x) // STEP)
    for _ in range(PASSES):
        order = r.permutation(len(x))
        for at in range(0, len(x), STEP):
            t += 1
            xb, yb = x[order[at : at + STEP]], soft[order[at : at + STEP]]
            h = np.maximum(xb @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = (z / z.sum(axis=1, keepdims=True) - yb) / len(xb)
            dh = (d @ w[2].T) * (h > 0)
            rate = 2e-3 * (1 - t / (all_steps + 1))
            for i, g in enumerate((xb.T @ dh + 1e-4 * w[0], dh.sum(axis=0), h.T @ d + 1e-4 * w[2], d.sum(axis=0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Router(float(scale), *w)


def fit(rows: DataFrame, total: int, size: int, sample: int = SAMPLE, part_rows: int = PART_ROWS, most_parts: int = MOST_PARTS) -> Router | None:
    """A router fitted on about `sample` of rows (v; `total` of them, all different), chosen by hash; None where one part will do.
    Only the sample, which is bounded, reaches the driver and one task."""
    spark = rows.sparkSession
    parts = min(most_parts, -(-total // part_rows))
    if parts < 2:
        return None
    if total > sample:
        rows = rows.where(F.pmod(F.xxhash64("v"), F.lit(1 << 31)) < int((1 << 31) * sample / total))
    chosen = np.frombuffer(b"".join(bytes(r[0]) for r in rows.select("v").orderBy("v").collect()), "<f8").reshape(-1, size)
    if len(chosen) <= max(parts, NEAR + 1):
        return None
    shared = spark.sparkContext.broadcast(chosen)
    near_k = min(NEAR, len(chosen) - 1)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column(0).to_pylist():
                places = np.arange(at, min(at + 512, len(shared.value)))
                found = graph(shared.value, shared.value[places], places, near_k)
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([found.astype("<i4").tobytes()], pa.binary())], names=["at", "near"])

    def router(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(pair for b in batches for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        near = np.frombuffer(b"".join(x for _, x in got), "<i4").reshape(-1, near_k).astype(np.int64)
        made = learned(shared.value, near, balanced(near, parts), parts)
        yield pa.RecordBatch.from_arrays([pa.array([made.dump()], pa.binary())], names=["model"])

    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-len(chosen) // 512))
    found = spark.range(0, len(chosen), 512, tasks).mapInArrow(edges, "at bigint, near binary")
    return Router.load(bytes(found.coalesce(1).mapInArrow(router, "model binary").first()[0]))


def search(df: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", mass: float = MASS, sample: int = SAMPLE, part_rows: int = PART_ROWS, most_parts: int = MOST_PARTS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id whose row fulfils `queries` (a condition on id_col) the k rows with other ids
    that have the largest inner product, in doubles summed in the order of components, ties to the smaller id, null ids last.
    Repeated rows (equal id and vector) count once; rows that share an id but not a vector are queries and candidates of their
    own, never each other's. Vectors of other lengths are padded with zeros. An empty table gives no rows."""
    spark = df.sparkSession
    all_ = written(vectors(df, id_col, vector_col), "vectors")
    first = all_.select("v").first()
    if first is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    size = len(bytes(first[0])) // 8
    # At most k + 1 rows of each vector (limited in each task before the shuffle).
    order = Window.partitionBy("v").orderBy(F.col("id").asc_nulls_last())
    rows = all_.distinct().withColumn("n_", F.row_number().over(order)).where(F.col("n_") <= k + 1)
    rows = written(rows, "candidates")
    distinct = rows.where("n_ = 1")
    router = fit(distinct, distinct.count(), size, sample, part_rows, most_parts)
    model = spark.sparkContext.broadcast(router.dump() if router else b"")
    asked = all_.where(queries).select(F.col("id").alias("query_id"), F.col("v").alias("q")).distinct()

    def routed(most: float | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            to = Router.load(model.value) if model.value else None
            for batch in batches:
                at = batch.schema.get_field_index("v")
                if to is None or not batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.zeros(batch.num_rows, np.int32))], names=[*batch.schema.names, "part"])
                    continue
                p = to(_matrix(batch.column(at), size))
                if most is None:
                    row, part = np.arange(len(p)), p.argmax(axis=1)
                else:
                    by = np.argsort(-p, axis=1, kind="stable")
                    held = np.cumsum(np.take_along_axis(p, by, axis=1), axis=1)
                    take = np.concatenate((np.ones((len(p), 1), bool), held[:, :-1] < most), axis=1)
                    row, part = np.nonzero(take)[0], by[take]
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(row)).columns, pa.array(part.astype(np.int32))], names=[*batch.schema.names, "part"])

        return run

    index = written(rows.select("id", "v").mapInArrow(routed(None), "id bigint, v binary, part int"), "index")
    sizes = index.groupBy("part").agg(F.count("*").alias("n")).select(F.col("part").alias("p_"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    blocks = index.join(F.broadcast(sizes), F.col("part") == F.col("p_"))  # a row for each part, of which there are most_parts
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.col("blocks")).cast("int"))
    goes = asked.select(F.col("q").alias("v")).distinct().mapInArrow(routed(mass), "v binary, part int")
    goes = goes.join(F.broadcast(sizes), F.col("part") == F.col("p_")).select("v", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    # Queries of a block are dealt out to groups of about QUERIES by hash; their number is known beforehand from counts.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    goes = written(goes, "routed")
    held = _packed(blocks.select("part", "block", "id", "v"), tasks, "held", BLOCK)
    ask = _packed(goes.select("part", "block", F.lit(None).cast("bigint").alias("id"), "v"), tasks, "ask", QUERIES)
    pairs = ask.select("part", "block", F.col("vs").alias("qs")).join(held, ["part", "block"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qs, ids, vs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                yield _best(np.frombuffer(qs, "<f8").reshape(-1, size), ids, np.frombuffer(vs, "<f8").reshape(-1, size), k + 1)

    found = pairs.select("qs", "ids", "vs").mapInArrow(best, "q binary, vec_id bigint, score double")
    top = Window.partitionBy("q").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    found = found.withColumn("r_", F.row_number().over(top)).where(F.col("r_") <= k + 1)
    lists = found.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r_", "vec_id", "score"))).alias("got"))
    out = asked.join(lists, "q").select("query_id", F.slice(F.filter("got", lambda x: ~x["vec_id"].eqNullSafe(F.col("query_id"))), 1, k).alias("got"))
    out = out.select("query_id", F.posexplode("got").alias("r_", "g"))
    return out.select("query_id", (F.col("r_") + 1).cast("int").alias("rank"), F.col("g.vec_id").alias("vec_id"), F.col("g.score").alias("score"))


def _packed(df: DataFrame, tasks: int, name: str, most: int) -> DataFrame:
    """Rows (part, block, id, v) → (part, block, ids, vs), at most `most` rows in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vs = None, [], []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([b"".join(vs)], pa.binary())], names=["part", "block", "ids", "vs"])

        for batch in batches:
            for part, block, id_, v in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if key is not None and ((part, block) != key or len(ids) >= most):
                    yield flush()
                    ids, vs = [], []
                key = (part, block)
                ids.append(id_)
                vs.append(v)
        if key is not None:
            yield flush()

    # Rows of a block go to one place, or a block of many queries to several: by a hash of their own in a few lanes.
    lanes = df.withColumn("lane", F.pmod(F.xxhash64("v", F.lit("lane")), F.lit(4)) if name == "ask" else F.lit(0))
    lanes = lanes.repartition(tasks, "part", "block", "lane").sortWithinPartitions("part", "block", "lane").select("part", "block", "id", "v")
    return written(lanes.mapInArrow(run, "part int, block int, ids array<bigint>, vs binary"), name)


def _best(q: np.ndarray, ids: list[int | None], x: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best of x for each of q: chosen in single precision with a margin beyond its error, scored in double precision."""
    s = q.astype(np.float32) @ x.astype(np.float32).T
    low = np.full((len(q), 1), -np.inf, np.float32)
    if len(x) > k:
        margin = 2.0**-22 * (q.shape[1] + 2) * np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1).max())
        low = (-np.partition(-s, k - 1, axis=1)[:, k - 1] - margin)[:, None]
    s = np.where(np.isfinite(s), s, np.inf)  # beyond single precision: scored all the same
    a, b = np.nonzero(s >= np.where(np.isfinite(low), low, -np.inf))
    score = np.zeros(len(a))
    for d in range(q.shape[1]):
        score += q[a, d] * x[b, d]
    id_ = np.array([np.iinfo(np.int64).max if i is None else i for i in ids])[b]
    order = np.lexsort((id_, -score, a))
    a, b, score = a[order], b[order], score[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    keep = place < k
    a, b, score = a[keep], b[keep], score[keep]
    return pa.RecordBatch.from_arrays([_binary(q).take(pa.array(a)), pa.array([ids[i] for i in b.tolist()], pa.int64()), pa.array(score)], names=["q", "vec_id", "score"])
