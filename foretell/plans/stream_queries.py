"""Streaming and export queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from foretell.plans.market_queries import predictions
from foretell.plans.registry import registry
from foretell.plans.views import PRELUDE
from foretell.sources import sinks
from foretell.sources.shared import shared_dir
from foretell.streaming import live, rolling

query, QUERIES, SQL = registry()

#: Moments at which the average over 6 hours of a key changes, up to the last watermark, and the averages then.
_MOMENTS = """
WITH e AS (SELECT {key} AS key, epoch_us(ts) AS t, (user_id % 100) / 100.0 AS price, round(abs(value), 2) + 1 AS size FROM events),
w AS (SELECT max(t) // 1000 * 1000 - 21600000000 AS until FROM e),
p AS (SELECT DISTINCT key, t FROM (SELECT key, t FROM e UNION ALL SELECT key, t + 21600000001 FROM e)),
"""


def _window(name: str, points: str) -> str:
    return f"""{name} AS (SELECT key, t, n, volume, floor(paid / volume * 10000 + 0.500001) / 10000 AS vwap FROM (
  SELECT key, t, k, count(price) OVER r AS n, coalesce(sum(size) OVER r, 0) AS volume, sum(price * size) OVER r AS paid
  FROM (SELECT key, t, price, size, 1 AS k FROM e UNION ALL SELECT key, t, NULL, NULL, 0 FROM {points})
  WINDOW r AS (PARTITION BY key ORDER BY t RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW)) WHERE k = 0)"""


def _arriving(spark, sf):
    """The trades in three parts by time, of which a tenth comes up to three hours late."""
    t = spark.read.parquet(f"{sf}/events.parquet")
    rows = t.select("event_id", "event_type", "user_id", F.col("ts").cast("timestamp").alias("ts"), ((F.col("user_id") % 100) / 100.0).alias("price"), (F.round(F.abs("value"), 2) + 1).alias("size"))
    first, last = t.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    comes = F.unix_micros("ts") + F.when(F.col("event_id") % 10 == 0, 3 * 3_600_000_000).otherwise(0)
    part = F.floor((comes - first) * 3 / (last + 1 - first))
    return [rows.filter(part == k if k < 2 else part >= 2).drop("event_id") for k in range(3)]


def _rounded(name):
    return (F.floor(F.col(name) * 10000 + 0.500001) / 10000).alias(name)


@query(_MOMENTS.format(key="event_type") + _window("x", "p") + " SELECT key AS event_type, t AS at_us, vwap, n AS trade_count, round(volume, 2) AS volume FROM x, w WHERE t < until")
def stream_trade_by_trade(spark, sf):
    out = rolling.replay(_arriving(spark, sf), lambda s: rolling.follow(s, ["event_type"]), shared_dir(spark))
    return out.select("event_type", "at_us", _rounded("vwap"), "trade_count", F.round("volume", 2).alias("volume"))


@query(
    _MOMENTS.format(key="user_id")
    + _window("y", "p")
    + """, ends AS (SELECT key, t + 604800000001 AS t FROM (SELECT key, t, lead(t) OVER (PARTITION BY key ORDER BY t) AS later FROM y WHERE n >= 3) WHERE later IS NULL OR later > t + 604800000001),
points AS (SELECT key, t FROM p UNION SELECT key, t FROM ends), """
    + _window("x", "points")
    + """, g AS (SELECT *, max(CASE WHEN n >= 3 THEN {'t': t, 'v': vwap} END) OVER (PARTITION BY key ORDER BY t) AS good FROM x)
SELECT key AS user_id, t AS at_us, n AS trade_count, CASE WHEN n >= 3 THEN 'live' WHEN t - good.t <= 604800000000 THEN 'stale' ELSE 'none' END AS status,
       CASE WHEN n >= 3 THEN vwap WHEN t - good.t <= 604800000000 THEN good.v END AS price FROM g, w WHERE t < until"""
)
def stream_stale_fallback(spark, sf):
    out = rolling.replay(_arriving(spark, sf), lambda s: rolling.follow(s, ["user_id"], least=3, buckets=1024), shared_dir(spark))
    return out.select("user_id", "at_us", "trade_count", "status", _rounded("price"))


@query("WITH e AS (SELECT event_type, CAST(floor(epoch(ts)) AS BIGINT) AS ts, (user_id % 100) / 100.0 AS price, round(abs(value), 2) + 1 AS size FROM events), w AS (SELECT e.*, ts // 3600 * 3600 - k * 3600 AS window_start FROM e, range(6) r(k)) SELECT event_type, window_start, floor(sum(price * size) / sum(size) * 10000 + 0.500001) / 10000 AS vwap, count(*) AS trade_count, round(sum(size), 2) AS volume FROM w GROUP BY 1, 2")
def stream_rolling_vwap(spark, sf):
    return live.finish(live.rolling_vwap(live.trades(spark, sf), ["event_type"]), shared_dir(spark), "complete")


@query("SELECT user_id, event_type, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day, count(*) AS calls FROM events GROUP BY ALL")
def stream_usage(spark, sf):
    return live.finish(live.usage(live.trades(spark, sf), "user_id", "event_type"), shared_dir(spark), "complete")


@query("SELECT event_type, CASE WHEN count(*) >= 10 THEN round(sum(price * size) / sum(size), 4) END AS vwap, CAST(CASE WHEN count(*) >= 10 THEN 1 ELSE 3 END AS INTEGER) AS tier, false AS stale FROM (SELECT event_type, (user_id % 100) / 100.0 AS price, round(abs(value), 2) + 1 AS size FROM events) GROUP BY 1")
def stream_last_good(spark, sf):
    return live.finish(live.last_good(live.trades(spark, sf), "event_type"), shared_dir(spark), "append")


@query(", a AS (SELECT category, days, round(avg((p - outcome) * (p - outcome)), 6) AS brier, count(*) AS n FROM predictions GROUP BY 1, 2) SELECT category, string_agg(CAST(days AS VARCHAR), ',' ORDER BY days) AS days, string_agg(CAST(n AS VARCHAR), ',' ORDER BY days) AS n FROM a GROUP BY 1", PRELUDE)
def column_export(spark, sf):
    p = predictions(spark, sf).groupBy("category", "days").agg(F.count("*").alias("n"))
    arrays = sinks.column_arrays(p, "category", "days", ["n"])
    return arrays.select("category", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("days", "n")])
