"""Point-in-time lookups: the value a series had at a cutoff.

`backward` has three plans.  "agg" joins on the key and keeps the latest row by `max_by`, with partial aggregation; it suits few rows a key.  "merge" unions cutoffs into the series and carries the last value forward in one sort by (key, time); it never multiplies rows.  "scan" does the same by the segmented scan, so a hot key is dealt to all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foretell.operators.scan import running


def _latest(value: Column, ts: str, tie: list[str]) -> Column:
    return F.max_by(value, F.struct(ts, *tie))


def backward(left: DataFrame, right: DataFrame, key: str, at: str, ts: str, value: str, tie: list[str], out: str = "price", strategy: str = "agg", lower: str | None = None) -> DataFrame:
    """left with `out`: the last `value` of right with ts <= at (and >= lower, a column of left, if given); null if there is none.  left's rows are distinct."""
    if strategy in ("merge", "scan"):
        if lower is not None:
            raise ValueError("a lower bound needs strategy='agg'")
        own = left.select("*", F.col(at).alias("_at"), F.lit(1).alias("_kind"))
        series = right.select(F.col(key), F.col(ts).alias("_at"), F.lit(0).alias("_kind"), F.col(value).alias("_value"), *[F.col(t).alias(f"_tie{i}") for i, t in enumerate(tie)])
        both = own.unionByName(series, allowMissingColumns=True)
        if strategy == "scan":
            return running(both, [key], ["_at", "_kind", *[f"_tie{i}" for i in range(len(tie))]], lasts={out: F.col("_value")}).filter("_kind = 1").select(*left.columns, out)
        line = Window.partitionBy(key).orderBy("_at", "_kind", *[f"_tie{i}" for i in range(len(tie))]).rowsBetween(Window.unboundedPreceding, 0)
        return both.withColumn(out, F.last("_value", ignorenulls=True).over(line)).filter("_kind = 1").select(*left.columns, out)
    near = right.select(F.col(key).alias("_key"), F.col(ts).alias("_ts"), F.col(value).alias("_value"), *[F.col(t).alias(f"_tie{i}") for i, t in enumerate(tie)])
    cond = (F.col(key) == F.col("_key")) & (F.col("_ts") <= F.col(at))
    if lower is not None:
        cond = cond & (F.col("_ts") >= F.col(lower))
    joined = left.join(near, cond, "left")
    return joined.groupBy(*left.columns).agg(_latest(F.col("_value"), "_ts", [f"_tie{i}" for i in range(len(tie))]).alias(out))


def _with_series(left: DataFrame, right: DataFrame, key: str, columns: list[tuple[str, str]]) -> DataFrame:
    return left.join(right.select(F.col(key).alias("_key"), *[F.col(c).alias(n) for c, n in columns]), F.col(key) == F.col("_key"), "left")


def backward_or_first(left: DataFrame, right: DataFrame, key: str, at: str, ts: str, value: str, tie: list[str], out: str = "price") -> DataFrame:
    """As `backward`, but the earliest value where nothing lies before the cutoff."""
    names = [f"_tie{i}" for i in range(len(tie))]
    joined = _with_series(left, right, key, [(ts, "_ts"), (value, "_value"), *zip(tie, names)])
    before = F.max_by("_value", F.when(F.col("_ts") <= F.col(at), F.struct("_ts", *names)))
    return joined.groupBy(*left.columns).agg(F.coalesce(before, F.min_by("_value", F.struct("_ts", *names))).alias(out))


def nearest(left: DataFrame, right: DataFrame, key: str, at: str, ts: str, value: str, tie: list[str], out: str = "price") -> DataFrame:
    """The value closest in time to the cutoff, before or after; ties to the smaller tie columns."""
    names = [f"_tie{i}" for i in range(len(tie))]
    joined = _with_series(left, right, key, [(ts, "_ts"), (value, "_value"), *zip(tie, names)])
    return joined.groupBy(*left.columns).agg(F.min_by("_value", F.struct(F.abs(F.col("_ts") - F.col(at)), "_ts", *names)).alias(out))


def snapshot_midpoint(left: DataFrame, books: DataFrame, key: str, at: str, ts: str, tie: list[str], out: str = "midpoint") -> DataFrame:
    """Midpoint of the latest snapshot at or before the cutoff: the stored one if in [0, 1], else (bid + ask) / 2 if bid > 0 and ask <= 1, else null.  The snapshot is picked before its values are tested."""
    snap = F.struct("midpoint", "best_bid", "best_ask")
    picked = backward(left, books.withColumn("_snap", snap), key, at, ts, "_snap", tie, "_s")
    mid, bid, ask = (F.col(f"_s.{c}") for c in ("midpoint", "best_bid", "best_ask"))
    return picked.withColumn(out, F.when(mid.between(0, 1), mid).when((bid > 0) & (ask <= 1), (bid + ask) / 2)).drop("_s")


def horizons(markets: DataFrame, ticks: DataFrame, days: list[int], reference: str = "close_ts") -> DataFrame:
    """Prediction per market and horizon: markets' columns, days and p, where a price existed by then.  Ticks meet a market once, whatever the number of horizons."""
    cut = lambda d: F.col(reference) - d * 86400
    t = ticks.select(F.col("market_id").alias("_key"), F.col("ts").alias("_ts"), F.col("price").alias("_value"), F.col("ord").alias("_ord"))
    joined = markets.join(t, (F.col("market_id") == F.col("_key")) & (F.col("_ts") <= cut(min(days))))
    when = F.struct("_ts", "_ord", "_value")
    each = [F.max_by("_value", F.when(F.col("_ts") <= cut(d), when)).alias(f"_p{d}") for d in days]
    wide = joined.groupBy(*markets.columns).agg(*each)
    long = wide.select(*markets.columns, F.inline(F.array(*[F.struct(F.lit(d).alias("days"), F.col(f"_p{d}").alias("p")) for d in days])))
    return long.filter(F.col("p").isNotNull())
