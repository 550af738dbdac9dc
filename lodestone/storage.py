"""Intermediate tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []
_own: list[str] = []


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a new folder where it is unset and the master is local, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir: name a folder that driver and executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="lodestone-graph-"))
        folder = _own[0]
    return folder.rstrip("/")


def stored(df: DataFrame, by: str | None = None, order: str | None = None) -> DataFrame:
    """df, written and read again. Its size is known to the planner, so a small one is broadcast and a large one is not.
    by: a folder for each value of a column of few values, of which a filter reads its own; order: the column that rows of
    a file are sorted by, so that a filter on it passes over most of them."""
    spark = df.sparkSession
    path = f"{root(spark)}/lodestone-graph/{uuid.uuid4().hex}"
    _made.append((spark, path))
    names = df.columns
    out = df if order is None else df.sortWithinPartitions(*([by] if by else []), order)
    if by is None:
        out.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path).select(*names)
    # A folder's name can't tell an empty string from null, so the value itself stays in the files too.
    out.withColumn("by_", F.concat(F.lit("="), F.col(by))).write.partitionBy("by_").parquet(path)
    return spark.read.schema(type(df.schema)([*df.schema.fields])).parquet(path).select(*names)


def bucketed(df: DataFrame, by: str, per_bucket: int = 2_000_000) -> DataFrame:
    """df, written in buckets of a column and sorted by it, so that a join on the column neither shuffles nor sorts it; as many
    buckets as the session's shuffles have partitions, more where rows are many."""
    spark = df.sparkSession
    held, n = counted(df)
    path = f"{root(spark)}/lodestone-graph/{uuid.uuid4().hex}"
    _made.append((spark, path))
    table = f"lodestone_{uuid.uuid4().hex}"
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // per_bucket))
    held.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).option("path", path).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the name only: the files lie outside the warehouse, and out is resolved
    return out


def parts(spark: SparkSession, rows: int, each: int = 1_000_000) -> int:
    """How many partitions so many rows need: as many as the session's shuffles have, more where rows are many, so that what a task
    holds doesn't grow with them."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def placed(df: DataFrame, by: str | tuple[str, ...], buckets: int, total: str | None = None, order: tuple[str, ...] = ()) -> tuple:
    """counted(df) in so many buckets of a column, and the sum of a column if one is named. Rows that lie in as many partitions of it
    are written where they are; a join with another table of as many buckets of its key shuffles neither. order: the columns that
    rows of a file are sorted by."""
    spark = df.sparkSession
    path = f"{root(spark)}/lodestone-graph/{uuid.uuid4().hex}"
    _made.append((spark, path))
    table, seen = f"lodestone_{uuid.uuid4().hex}", Observation()
    sums = [F.sum(total).alias("total")] if total else []
    out = df.observe(seen, F.count(F.lit(1)).alias("n"), *sums).write.bucketBy(buckets, *((by,) if isinstance(by, str) else by))
    (out.sortBy(*order) if order else out).option("path", path).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the name only, as in bucketed()
    n = int(seen.get["n"])
    return (out, n, int(seen.get["total"] or 0)) if total else (out, n)


def apart(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, for a union. Spark 4.1 takes a union of tables in equal buckets for one that lies in these, but reads it otherwise, so what is
    grouped by the keys (texts) comes out more than once; behind an expression it doesn't know the keys' buckets."""
    return df.withColumns({k: F.concat(k, F.lit("")) for k in keys}).select(*df.columns)


class Segments:
    """Rows that grow level by level. Levels are merged once there are many, small ones first, so that a row is written again a
    logarithmic number of times and a plan that reads them all stays short."""

    MOST = 6

    def __init__(self, df: DataFrame, n: int, by: str | tuple[str, ...] | None = None, buckets: int = 0) -> None:
        """by, buckets: levels come from placed() with these, and what is merged of them is placed likewise."""
        self.parts, self.empty, self.by, self.buckets = [(df, n)] if n else [], df, by, buckets
        self.keys = [] if by is None else [by] if isinstance(by, str) else list(by)

    def add(self, df: DataFrame, n: int) -> None:
        if n:
            self.parts.append((df, n))
        while len(self.parts) > self.MOST:
            i = min(range(len(self.parts) - 1), key=lambda i: self.parts[i][1] + self.parts[i + 1][1])
            (a, k), (b, m) = self.parts[i : i + 2]
            both = apart(a, self.keys).unionByName(apart(b, self.keys))
            self.parts[i : i + 2] = [(stored(both) if self.by is None else placed(both.repartition(self.buckets, *self.keys), self.by, self.buckets)[0], k + m)]

    def without(self, df: DataFrame) -> DataFrame:
        """The rows of df whose column `by` is in no level; df lies in as many partitions of it, so nothing is shuffled."""
        for part, _ in self.parts:
            df = df.join(part.select(*self.keys).hint("merge"), self.keys, "left_anti")
        return df

    def met(self, df: DataFrame) -> DataFrame:
        """The keys of df that are in a level, df lying in as many partitions of them. Levels pass by a hash table of df, unsorted."""
        met = [part.select(*self.keys).join(df.select(*self.keys).hint("shuffle_hash"), self.keys, "left_semi") for part, _ in self.parts]
        out = apart(met[0], self.keys)
        for m in met[1:]:
            out = out.unionByName(apart(m, self.keys))
        return out

    def table(self) -> DataFrame:
        if not self.parts:
            return self.empty
        out = apart(self.parts[0][0], self.keys)
        for df, _ in self.parts[1:]:
            out = out.unionByName(apart(df, self.keys))
        return out


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """stored(df), and its number of rows, counted as they are written."""
    seen = Observation()
    out = stored(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, int(seen.get["n"])


def signature(spark: SparkSession, path: str) -> tuple:
    """What tells a table at a path from an other that is there later: its files' names, sizes and times."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p)))


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session has ended
            return
