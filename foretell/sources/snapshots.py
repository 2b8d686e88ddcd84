"""A table with all its past versions, and what changed between them.

A version writes only what it changes: rows that are new or differ (`opened`), and keys whose row ended (`closed`), each in a folder of the version.  A row is valid from the version that opened it until the one that closed it.  A small file names the newest version; it is replaced by one rename after both folders are there, so readers never see half a version, and a version that failed is written anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ADDED, REMOVED, CHANGED = "added", "removed", "changed"


class Snapshots:
    """Versions of a table with a distinct, non-null key.  Columns may come later; before that they are null."""

    def __init__(self, spark: SparkSession, root: str, key: str):
        self.spark, self.root, self.key = spark, root, key

    def versions(self) -> int:
        """The newest complete version, 0 if there is none."""
        path, fs = self._path("current"), self._fs()
        return int(self.spark.read.text(str(path)).first()[0]) if fs.exists(path) else 0

    def save(self, df: DataFrame) -> int:
        """Add df as the next version; its number."""
        version, at = self.versions() + 1, lambda kind: f"{self.root}/{kind}/version={self.versions() + 1}"
        if version == 1:
            df.write.mode("overwrite").parquet(at("opened"))
            df.select(self.key, F.lit(0).alias("since")).limit(0).write.mode("overwrite").parquet(at("closed"))
        else:
            old = self._valid(version - 1)
            names = sorted({c for c in (*df.columns, *old.columns) if c not in (self.key, "since")})
            side = lambda rows, *more: rows.select(self.key, *more, F.struct(*[(F.col(f"`{c}`") if c in rows.columns else F.lit(None)).cast("string").alias(c) for c in names]).alias("row"))
            both = side(old, "since").withColumnRenamed("row", "_was").join(side(df).withColumnRenamed("row", "_is"), self.key, "full_outer")
            differs = both.filter(~F.col("_was").eqNullSafe(F.col("_is")))
            differs.filter("_was is not null").select(self.key, "since").write.mode("overwrite").parquet(at("closed"))
            df.join(differs.filter("_is is not null").select(self.key), self.key, "left_semi").write.mode("overwrite").parquet(at("opened"))
        self._point_to(version)
        return version

    def read(self, version: int | None = None) -> DataFrame:
        """The table as it was at a version (the newest by default)."""
        return self._valid(self.versions() if version is None else version).drop("since")

    def events(self, after: int, until: int) -> DataFrame:
        """key, version, change, column, old, new for every change between two versions: a row for a key that came or went (no column), else one for each column that differs, its values as text."""
        out = None
        for v in range(after + 1, until + 1):
            found = changes_by_column(self.read(v - 1) if v > 1 else self.read(v).limit(0), self.read(v), self.key).withColumn("version", F.lit(v))
            out = found if out is None else out.unionByName(found)
        return out

    def _valid(self, version: int) -> DataFrame:
        rows = self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/opened").filter(F.col("version") <= version).withColumnRenamed("version", "since")
        ended = self.spark.read.parquet(f"{self.root}/closed").filter(F.col("version") <= version).select(self.key, "since")
        return rows.join(ended, [self.key, "since"], "left_anti")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _point_to(self, version: int) -> None:
        fs, new, now = self._fs(), self._path(f"current.{version}"), self._path("current")
        out = fs.create(new, True)
        out.write(bytearray(str(version).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(now.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(new, now, options)


def changes_by_column(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, change, column, old, new: a row for a key that was added or removed, else one for each column whose value differs (as text, null and all)."""
    names = sorted({c for c in (*before.columns, *after.columns) if c != key})
    side = lambda rows, name: rows.select(key, F.struct(*[(F.col(f"`{c}`") if c in rows.columns else F.lit(None)).cast("string").alias(c) for c in names]).alias(name))
    both = side(before, "_a").join(side(after, "_b"), key, "full_outer")
    cell = lambda change, column, old, new: F.struct(F.lit(change).alias("change"), column.cast("string").alias("column"), old.cast("string").alias("old"), new.cast("string").alias("new"))
    none = F.lit(None)
    cells = F.filter(F.array(*[cell(CHANGED, F.lit(c), F.col("_a")[c], F.col("_b")[c]) for c in names]), lambda x: ~x.old.eqNullSafe(x.new))
    found = F.when(F.col("_a").isNull(), F.array(cell(ADDED, none, none, none))).when(F.col("_b").isNull(), F.array(cell(REMOVED, none, none, none))).otherwise(cells)
    return both.select(key, F.inline(found))


def typed_events(events: DataFrame, rows: DataFrame, key: str, types: dict[str, str], filled: dict[str, str], describe: list[str]) -> DataFrame:
    """Events as a readable log: version, key, type, details.

    A key that came is `market_added` with the columns `describe` of its row.  A column in `types` has its type whenever it gets a value, and the value as details; columns in `filled` that get their first value share their type, one row a key and version, as `column=value`.  rows: version, key and the columns of the table then.
    """
    came = events.filter(F.col("change") == ADDED).join(rows, ["version", key]).select("version", key, F.lit("market_added").alias("type"), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in describe]).alias("details"))
    given = events.filter((F.col("change") == CHANGED) & F.col("new").isNotNull())
    pick = lambda table: F.coalesce(*[F.when(F.col("column") == c, t) for c, t in table.items()])
    own = given.withColumn("type", pick(types)).filter("type is not null").select("version", key, "type", F.col("new").alias("details"))
    first = given.filter(F.col("old").isNull()).withColumn("type", pick(filled)).filter("type is not null")
    first = first.groupBy("version", key, "type").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "column", "new"))), " | ").alias("details"))
    return came.unionByName(own).unionByName(first)
