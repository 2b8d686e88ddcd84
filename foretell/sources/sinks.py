"""Sinks: fixed names, versions with rotation, column-oriented JSON, text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def overwrite(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).format(kind).options(**({"header": "true"} if kind == "csv" else {})).save(path)


def column_arrays(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row per key: the order column and each column as parallel arrays in that order.  A key's series is one value."""
    rows = F.sort_array(F.collect_list(F.struct(order, *columns))).alias("_rows")
    return df.groupBy(key).agg(rows).select(key, *[F.col(f"_rows.{c}").alias(c) for c in (order, *columns)])


def column_json(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    arrays = column_arrays(df, key, order, columns)
    return arrays.select(key, F.to_json(F.struct(order, *columns)).alias("json"))


def sorted_export(df: DataFrame, path: str, key: str, ts: str) -> None:
    """Flattened series, each file sorted by key and time."""
    df.repartition(key).sortWithinPartitions(key, ts).write.mode("overwrite").parquet(path)


def save_version(df: DataFrame, root: str, version: str, keep: int = 5) -> list[str]:
    """Writes root/version={version} and deletes all but the newest `keep` versions by name; the versions that stay."""
    df.write.mode("overwrite").parquet(f"{root}/version={version}")
    spark: SparkSession = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted((s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith("version=")), reverse=True)
    for old in names[keep:]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(path, old), True)
    return [n.removeprefix("version=") for n in names[:keep]]


def latex_rows(df: DataFrame, columns: list[str], places: int = 4) -> DataFrame:
    """A text row per row of a small result table: values joined by & and ended by a double backslash."""
    kinds = dict(df.dtypes)
    cells = [F.coalesce(F.format_number(c, places) if kinds[c] in ("double", "float") else F.col(c).cast("string"), F.lit("--")) for c in columns]
    return df.select(F.concat(F.concat_ws(" & ", *cells), F.lit(" \\\\")).alias("row"))
