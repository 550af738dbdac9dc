"""Running values along the rows of a key, whatever the key's share of all rows: rows are sorted over all tasks, each task
works along its own, and what a task's last run has so far (one row for each task) is added to the tasks behind it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, written


def scanned(df: DataFrame, key: str, order: list[str], name: str, words: tuple[str, ...] = ()) -> DataFrame:
    """df and: n_, a row's place among those of its key (bigint, not null) by `order`, from 1; and for each of words (bigint)
    w a column w_, the exclusive or of it over the rows of the key so far, the row's own included. Ties in `order` are equal
    rows or come in no stated order."""
    spark = df.sparkSession
    ship(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = [df.columns.index(c) for c in (key, *words)]
    made = ["part_", "n_", *(f"{w}_" for w in words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, n, held = TaskContext.get().partitionId(), None, 0, [0] * len(words)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, *cols = (batch.column(i).to_numpy(zero_copy_only=False) for i in at)
            first = np.concatenate(([True], keys[1:] != keys[:-1]))
            goes_on = last is not None and keys[0] == last
            start = np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))
            place = np.arange(len(keys)) - start + 1
            place[start == 0] += n if goes_on else 0
            out = [place]
            for j, w in enumerate(cols):
                run_ = np.bitwise_xor.accumulate(w)
                run_ = run_ ^ np.where(start > 0, run_[start - 1], 0)
                run_[start == 0] ^= np.int64(held[j] if goes_on else 0)
                out.append(run_)
            last, n, held = keys[-1], int(place[-1]), [int(x[-1]) for x in out[1:]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(keys), part, np.int32)), *(pa.array(x, pa.int64()) for x in out)], names=[*batch.schema.names, *made])

    schema = T.StructType([*df.schema.fields, T.StructField("part_", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in made[1:])])
    rows = written(df.repartitionByRange(tasks, key, *order).sortWithinPartitions(key, *order).mapInArrow(run, schema), name)
    # The last run of each task; max() takes the greatest key, and of its rows the one with the greatest place.
    tails = rows.groupBy("part_").agg(F.max(F.struct(key, *made[1:])).alias("t")).select("part_", "t.*")
    before = Window.partitionBy(key).orderBy("part_")
    sums = [F.sum("n_").over(before).alias("a0_"), *(F.expr(f"bit_xor({w}_)").over(before).alias(f"a{j}_") for j, w in enumerate(words, 1))]
    tails = tails.withColumn("next_", F.lead("part_").over(Window.orderBy("part_"))).select(F.col(key).alias("k_"), "next_", *sums)
    # One row for each task at most, so it can be broadcast.
    out = rows.join(F.broadcast(tails), (F.col(key) == F.col("k_")) & (F.col("part_") == F.col("next_")), "left")
    place = (F.col("n_") + F.coalesce("a0_", F.lit(0))).alias("n_")
    return out.select(*df.columns, place, *[F.col(f"{w}_").bitwiseXOR(F.coalesce(f"a{j}_", F.lit(0))).alias(f"{w}_") for j, w in enumerate(words, 1)])
