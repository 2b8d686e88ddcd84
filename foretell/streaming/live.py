"""Live metrics with Structured Streaming: rolling averages, counters, the last good value, and an upserted serving table."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foretell.operators.pricing import vwap

TRADE = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
STALE_DAYS = 7


def trades(spark: SparkSession, folder: str, files: str = "events*.parquet", schema: str = TRADE) -> DataFrame:
    """A stream of trades from files of a folder; a missing time is now."""
    raw = spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)
    ts = F.coalesce(F.col("ts").cast("timestamp"), F.current_timestamp())
    return raw.select("event_type", "user_id", ts.alias("ts"), ((F.col("user_id") % 100) / 100.0).alias("price"), (F.round(F.abs("value"), 2) + 1).alias("size"))


def rolling_vwap(stream: DataFrame, keys: list[str], window: str = "6 hours", slide: str = "1 hour") -> DataFrame:
    """Average, trades and volume of sliding windows; a trade later than one window length is dropped.  Windows slide in fixed steps, where the live servers evict trade by trade."""
    w = F.window("ts", window, slide)
    out = stream.withWatermark("ts", window).groupBy(w, *keys).agg(vwap(F.col("price"), F.col("size")).alias("vwap"), F.count("*").alias("trade_count"), F.sum("size").alias("volume"))
    return out.select(*keys, F.unix_timestamp("window.start").alias("window_start"), "vwap", "trade_count", F.round("volume", 2).alias("volume"))


def usage(stream: DataFrame, client: str, endpoint: str) -> DataFrame:
    """Calls per client, day and endpoint."""
    out = stream.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day"), client, endpoint).count()
    return out.select(client, endpoint, F.unix_timestamp("window.start").alias("day"), F.col("count").alias("calls"))


def last_good(stream: DataFrame, key: str, least: int = 10) -> DataFrame:
    """Per key and micro-batch: the average of its trades if they are at least `least` (tier 1), else the last good one while it is younger than STALE_DAYS (tier 3, stale), else null."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames))
        now = rows["ts"].max()
        if len(rows) >= least:
            value = float((rows["price"] * rows["size"]).sum() / rows["size"].sum())
            state.update((value, int(now.timestamp())))
            yield pd.DataFrame({key: [k[0]], "vwap": [round(value, 4)], "tier": [1], "stale": [False]})
        else:
            kept = state.get if state.exists else None
            fresh = kept is not None and now.timestamp() - kept[1] <= STALE_DAYS * 86400
            yield pd.DataFrame({key: [k[0]], "vwap": [round(kept[0], 4) if fresh else None], "tier": [3], "stale": [bool(fresh)]})

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} string, vwap double, tier int, stale boolean", "vwap double, at bigint", "append", GroupStateTimeout.NoTimeout)


def finish(stream: DataFrame, path: str, mode: str) -> DataFrame:
    """Runs a stream over what is there now and returns the rows of its sink.  Every micro-batch is written under its own id, so a repeated batch replaces itself; in complete mode the last batch is the result."""
    spark = stream.sparkSession
    out = f"{path}/{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    if mode == "complete":
        last = rows.agg(F.max("batch").alias("batch"))
        rows = rows.join(F.broadcast(last), "batch")
    return rows.drop("batch")


def upsert(serving: DataFrame, batch: DataFrame, key: str, version: str) -> DataFrame:
    """serving with the newest row per key of both."""
    both = serving.unionByName(batch, allowMissingColumns=True)
    return both.groupBy(key).agg(F.max_by(F.struct(*[c for c in both.columns if c != key]), version).alias("x")).select(key, "x.*")


def unexpired(serving: DataFrame, at: str, now: int, seconds: int = 30) -> DataFrame:
    """Rows of a serving table that are not older than their time to live."""
    return serving.filter(F.col(at) >= now - seconds)
