"""Market-data views over the star-schema tables, and the same views as SQL.

markets   orders: id, platform by even/odd customer, category, volume, close 60 days after the order date, outcome by status
ticks     lineitem: price 0..1 in tenths from the discount, size from the quantity, side and label from the flags
Timestamps are epoch seconds, worked out without a session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(column: str) -> Column:
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("market_id"),
        F.when(F.col("o_custkey") % 2 == 0, "polymarket").otherwise("kalshi").alias("platform"),
        F.col("o_custkey").alias("wallet"),
        F.col("o_orderpriority").alias("category"),
        F.col("o_totalprice").alias("volume_usd"),
        (epoch("o_orderdate") + 60 * DAY).alias("close_ts"),
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).alias("outcome"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("market_id"),
        epoch("l_shipdate").alias("ts"),
        F.round(F.col("l_discount") * 10, 2).alias("price"),
        F.col("l_quantity").alias("size"),
        (F.col("l_linenumber").cast("long") * 10**12 + F.col("l_partkey") * 10**5 + F.col("l_suppkey")).alias("ord"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("side"),
        F.round(F.col("l_tax"), 2).alias("tax"),
    )


#: The same views for DuckDB; a query's SQL follows as `, name AS (...) SELECT ...` or `SELECT ...`.
PRELUDE = """
WITH markets AS (
  SELECT o_orderkey AS market_id, CASE WHEN o_custkey % 2 = 0 THEN 'polymarket' ELSE 'kalshi' END AS platform, o_custkey AS wallet,
         o_orderpriority AS category, o_totalprice AS volume_usd, CAST(epoch(o_orderdate) AS BIGINT) + 60 * 86400 AS close_ts,
         CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS outcome
  FROM orders),
ticks AS (
  SELECT l_orderkey AS market_id, CAST(epoch(l_shipdate) AS BIGINT) AS ts, round(l_discount * 10, 2) AS price, l_quantity AS size,
         CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 100000 + l_suppkey AS ord, l_returnflag AS flag, l_linestatus AS side, round(l_tax, 2) AS tax
  FROM lineitem),
predictions AS (
  SELECT m.market_id, m.platform, m.category, m.volume_usd, m.outcome, h.days, (array_agg(t.price ORDER BY t.ts DESC, t.ord DESC, t.price DESC))[1] AS p
  FROM markets m CROSS JOIN (VALUES (1), (7), (30)) h(days) JOIN ticks t ON t.market_id = m.market_id AND t.ts <= m.close_ts - h.days * 86400
  WHERE m.outcome IS NOT NULL GROUP BY ALL)
"""
