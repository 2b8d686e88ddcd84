"""Readers: CSV with a schema, JSON maps of series, candles, newest file, cutoffs, and paged listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foretell.sources.shared import written

CANDLE = "struct<end_period_ts:bigint,price:struct<close:int,previous:int>,yes_bid:struct<close:int>,yes_ask:struct<close:int>>"

#: The largest file that is read as one row.
MOST_BYTES = 256 * 2**20


def csv(spark: SparkSession, path: str, schema: str, keep: list[str] | None = None) -> DataFrame:
    """A CSV file with a header and a given schema (ids stay text); only `keep` is read if given."""
    df = spark.read.csv(path, schema=schema, header=True)
    return df.select(*keep) if keep else df


def series_map(spark: SparkSession, path: str, key: str = "token_id", lines: bool = False) -> DataFrame:
    """JSON objects {id: [{t, p}, ...]} as key, ts, price: one object a file, or with `lines` one a line, which lets a large file be split.  A file of one object is one row of one task, so files above MOST_BYTES are refused in that form."""
    if not lines:
        refuse_above(spark, path, MOST_BYTES)
    lines = spark.read.text(path, wholetext=not lines)
    parsed = lines.select(F.from_json("value", "map<string,array<struct<t:bigint,p:double>>>").alias("m"))
    return parsed.select(F.explode("m").alias(key, "s")).select(key, F.inline("s")).withColumnsRenamed({"t": "ts", "p": "price"})


def refuse_above(spark: SparkSession, path: str, most: int) -> None:
    """An error if a file at a path (a glob, or a folder) has more than `most` bytes."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for top in fs.globStatus(at) or []:
        for s in fs.listStatus(top.getPath()):
            if s.isFile() and s.getLen() > most:
                raise ValueError(f"{s.getPath()} has {s.getLen()} bytes, more than {most} in one row: write one object a line and read with lines=True")


def candle_map(spark: SparkSession, path: str, key: str = "ticker") -> DataFrame:
    """JSON objects {ticker: [candle, ...]} as key, ts and the probability of each candle."""
    from foretell.operators.pricing import candle_price

    lines = spark.read.text(path, wholetext=True)
    rows = lines.select(F.explode(F.from_json("value", f"map<string,array<{CANDLE}>>")).alias(key, "s")).select(key, F.explode("s").alias("c"))
    c = lambda f: F.col(f"c.{f}")
    return rows.select(key, c("end_period_ts").alias("ts"), candle_price(c("price.close"), c("price.previous"), c("yes_bid.close"), c("yes_ask.close")).alias("price"))


def newest(spark: SparkSession, pattern: str) -> str:
    """Path of the file with the newest modification time that fits a glob, by Spark's own file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    if not found:
        raise FileNotFoundError(pattern)
    return max(((s.getModificationTime(), str(s.getPath())) for s in found))[1]


def until(df: DataFrame, column: str, cutoff: str | None) -> DataFrame:
    """Rows up to a cutoff, which reaches the scan; all rows without one."""
    return df if cutoff is None else df.filter(F.col(column) <= F.lit(cutoff).cast(df.schema[column].dataType))


def parsed_time(text: Column) -> Column:
    """Timestamps in mixed forms; what is none becomes null."""
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ssX")))


def paged(spark: SparkSession, path: str) -> DataFrame:
    """Records (id, payload) of a paged listing, files `{path}/page-{n}.json` or folders `{path}/page={n}`, each {"items": [...], "next": bool}: all pages up to the first without a next one.  A page is a row of the scan, so pages are read in parallel from any store that Spark reads."""
    pages = spark.read.text(f"{path}/page[-=]*", wholetext=True)
    pages = pages.select(F.regexp_extract("_metadata.file_path", r"/page[-=](\d+)(?:\.json$|/)", 1).cast("long").alias("n"), F.try_parse_json("value").alias("page"))
    ends = pages.filter(~F.coalesce(F.try_variant_get("page", "$.next", "boolean"), F.lit(False))).agg(F.min("n").alias("last"))
    kept = pages.join(F.broadcast(ends), F.col("last").isNull() | (F.col("n") <= F.col("last")))  # ends has one row
    items = kept.select(F.explode(F.try_variant_get("page", "$.items", "array<variant>")).alias("item"))
    return items.select(F.try_variant_get("item", "$.id", "string").alias("id"), F.to_json("item").alias("payload"))


def cursor_pages(spark: SparkSession, path: str, start: str, limit: int | None = None) -> DataFrame:
    """Records (page, id, payload) of a listing whose pages name their successor: JSON lines {"cursor", "items", "next_cursor"}.  `page` is the page's place (from 0) in the chain that begins with the cursor `start`; pages that the chain does not reach are left out, and a chain that runs into itself ends there.  limit: pages at most.

    The chain is ordered by doubling: with the pages reached so far and the pointers that skip as many, one round reaches twice as many, so any length takes log rounds of joins on cursors.
    """
    pages = spark.read.schema("cursor string, next_cursor string, items string").json(path)
    step = written(pages.filter("next_cursor is not null and next_cursor <> ''").groupBy("cursor").agg(F.min("next_cursor").alias("next")))
    reached, skip, n = written(spark.createDataFrame([(start, 0)], "cursor string, page long")), 1, 1
    while limit is None or skip < limit:
        further = reached.join(step, "cursor").select(F.col("next").alias("cursor"), (F.col("page") + skip).alias("page"))
        reached = written(reached.union(further).groupBy("cursor").agg(F.min("page").alias("page")))
        now = reached.count()
        if now == n:
            break
        hop = step.select(F.col("cursor").alias("next"), F.col("next").alias("far"))
        n, skip, step = now, 2 * skip, written(step.join(hop, "next").select("cursor", F.col("far").alias("next")))
    kept = pages.join(reached if limit is None else reached.filter(F.col("page") < limit), "cursor")
    one = kept.groupBy("page").agg(F.min("items").alias("items"))
    items = one.select("page", F.explode(F.try_variant_get(F.try_parse_json("items"), "$", "array<variant>")).alias("item"))
    return items.select("page", F.try_variant_get("item", "$.id", "string").alias("id"), F.to_json("item").alias("payload"))
