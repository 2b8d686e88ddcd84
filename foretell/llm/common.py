"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from foretell.sources.shared import shared_dir

#: Drops the shuffle files of a statement at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The characters `[\x20\x09-\x0D]`.
BLANKS = " \t\n\x0b\x0c\r"
#: What materialise() has written inside the innermost scratch().
_WRITTEN: ContextVar[list[DataFrame] | None] = ContextVar("written", default=None)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def materialise(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back: cuts the lineage and survives lost executors.  The shuffle files that led to it go at once: no later step reads them, and many rounds over small tables would otherwise leave as many files as tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    held = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if held is None else spark.conf.set(_CLEANUP, held)
    back = spark.read.schema(_nullable(df.schema)).parquet(path)
    back._shared_path = path
    if (inside := _WRITTEN.get()) is not None:
        inside.append(back)
    return back


def few(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """df, which has at most `rows` rows, in a task for every `each` of them, or one for each core if that is more; never in more partitions than it has.  Small tables that rounds of joins write again and again otherwise cost as many tasks and files as the session shuffles to."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialise() wrote and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._shared_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """The tables that materialise() writes inside the block; those still in the list at its end are deleted."""
    tables: list[DataFrame] = []
    outer = _WRITTEN.set(tables)
    try:
        yield tables
    finally:
        _WRITTEN.reset(outer)
        discard(*tables)


def in_lots(run: Callable, rows: int = 512) -> Callable:
    """run, a function for mapInArrow, over batches of at most `rows` rows, so that a task holds few texts at a time; see tidy()."""
    return tidy(lambda batches: run(b.slice(k, rows) for b in batches for k in range(0, b.num_rows, rows)))


def tidy(run: Callable) -> Callable:
    """run, after whose last batch a task gives the memory that it freed back to the machine: workers live on idle, next to those of later stages."""

    def go(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # a C library without it
            pass

    return go


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df does not have, so that helpers never clash with a caller's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once a row: an expression inside a lambda function is otherwise worked out at each of its uses."""
    return F.transform(F.array(value), use)[0]


def small_side(df: DataFrame, most_rows: int = 2_000_000) -> DataFrame:
    """df marked for broadcast if it has at most `most_rows` rows of a few bytes, which is counted first; otherwise as it is, for an ordinary shuffled join."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def bounded_sample(df: DataFrame, by: str, key: str, n: int, shards: int = 16) -> DataFrame:
    """The n rows of each value of `by` whose hashed key is smallest.  Shards of a value keep n rows each first, so the last step sees shards * n rows of a value at most."""
    order = [F.xxhash64(key), F.col(key)]
    rows = df.withColumn("_shard", F.pmod(F.hash(key), F.lit(shards)))
    few = rows.withColumn("_n", F.row_number().over(Window.partitionBy(by, "_shard").orderBy(*order))).filter(F.col("_n") <= n)
    return few.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_n") <= n).drop("_n", "_shard")


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def ranked(df: DataFrame, key: str, order: list[str], shards: int | None = None) -> DataFrame:
    """df with `rank` (from 0) within `key`, dense and without gaps, for keys that may hold a third of all rows.

    Rows of a key are dealt to `shards` (as many as the session shuffles to, 256 at least) by the hash of `order`; each shard numbers its own rows, and a shard's offset is the number of rows of its key in earlier shards.  The offsets table has at most keys * shards rows and is joined by hash, so no task ever holds a key.
    """
    shards = shards or max(256, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.withColumn("_shard", F.pmod(F.xxhash64(*order), F.lit(shards)).cast("int"))
    local = dealt.withColumn("_local", F.row_number().over(Window.partitionBy(key, "_shard").orderBy(*order)))
    before = Window.partitionBy(key).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(key, "_shard").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    offsets = offsets.select(F.col(key).alias("_key"), F.col("_shard").alias("_s"), "_before")
    joined = local.join(offsets, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_shard") == F.col("_s")))
    return joined.withColumn("rank", F.col("_before") + F.col("_local") - 1).drop("_shard", "_local", "_key", "_s", "_before")
