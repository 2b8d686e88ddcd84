"""Window prices, volume-weighted averages, tiers and cross-venue prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretell.functions.numbers import half_up
from foretell.operators.scan import running

#: Window lengths in hours and the least number of trades of the tiered average.
TIER_HOURS, LEAST_TRADES = (6, 12, 24), 10


def window_means(left: DataFrame, ticks: DataFrame, at: str, windows: dict[str, int], fallback: bool = True, lasts: dict[str, Column] | None = None, strategy: str = "scan") -> DataFrame:
    """left with, for each named window of seconds, the unweighted mean price in [at - window, at]; an empty window gives the last earlier price if `fallback`.  `lasts` adds last values, up to `at`, of expressions over ticks.  left's rows are distinct.

    Means come from prefix sums: the borders of the windows are rows among the ticks of their market, one segmented scan gives every border the sum and the number of prices before it, and a window is the difference of two borders.  No tick meets a window; a market may hold any share of the ticks.  Sums are decimals of 12 places, so differences are exact to these.  strategy="agg" joins each row with its market's ticks and aggregates instead, which suits few rows and few ticks a market: no border is sorted among them.
    """
    lasts, number = lasts or {}, lambda c: c.cast("decimal(28,12)")
    order = ["_at", "_kind", "_tie1", "_tie2"]
    t = ticks.select(F.col("market_id").alias("_m"), F.col("ts").alias("_at"), F.lit(0).alias("_kind"), F.col("ord").alias("_tie1"), F.col("price").alias("_tie2"), F.col("price").alias("_p"), *[c.alias(f"_v{i}") for i, c in enumerate(lasts.values())])
    if strategy == "agg":
        joined = left.join(t, (F.col("market_id") == F.col("_m")) & (F.col("_at") <= F.col(at)), "left")
        inside = lambda w: (F.col("_at") >= F.col(at) - w) & F.col("_p").isNotNull()
        newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("_at", "_tie1", "_tie2")))
        sums = [x for i, w in enumerate(windows.values()) for x in (F.sum(F.when(inside(w), number(F.col("_p")))).alias(f"_s{i}"), F.count_if(inside(w)).alias(f"_c{i}"))]
        wide = joined.groupBy(*left.columns).agg(*sums, newest("_p").alias("_last"), *[newest(f"_v{i}").alias(f"_l{i}") for i in range(len(lasts))])
        last = F.col("_last") if fallback else F.lit(None).cast("double")
        mean = lambda i: F.when(F.col(f"_c{i}") > 0, F.col(f"_s{i}").cast("double") / F.col(f"_c{i}"))
        return wide.select(*left.columns, *[F.coalesce(mean(i), last).alias(name) for i, name in enumerate(windows)], *[F.col(f"_l{i}").alias(name) for i, name in enumerate(lasts)])
    own = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    starts = [F.struct((F.col(at) - w).alias("_at"), F.lit(-1).alias("_kind"), F.lit(name).alias("_name")) for name, w in windows.items()]
    borders = left.select(F.col("market_id").alias("_m"), own.alias("_row"), F.inline(F.array(*starts, F.struct(F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit("").alias("_name")))))
    both = t.unionByName(borders, allowMissingColumns=True)
    scanned = running(both, ["_m"], order, totals={"_sum": number(F.col("_p")), "_n": F.when(F.col("_p").isNotNull(), 1).otherwise(0)}, lasts={"_last": F.col("_p")} | {f"_l{i}": F.col(f"_v{i}") for i in range(len(lasts))})
    of = lambda name, c: F.max(F.when(F.col("_name") == name, F.col(c)))
    sums = [x for i, name in enumerate(windows) for x in (of(name, "_sum").alias(f"_s{i}"), of(name, "_n").alias(f"_c{i}"))]
    ends = [of("", c).alias(c) for c in ("_sum", "_n", "_last", *[f"_l{i}" for i in range(len(lasts))])]
    wide = scanned.filter("_kind <> 0").groupBy("_row").agg(*sums, *ends)
    last = F.col("_last") if fallback else F.lit(None).cast("double")
    mean = lambda i: F.when(F.col("_n") > F.col(f"_c{i}"), (F.col("_sum") - F.col(f"_s{i}")).cast("double") / (F.col("_n") - F.col(f"_c{i}")))
    return wide.select("_row.*", *[F.coalesce(mean(i), last).alias(name) for i, name in enumerate(windows)], *[F.col(f"_l{i}").alias(name) for i, name in enumerate(lasts)])


def vwap(price: Column, size: Column, keep: Column | None = None) -> Column:
    """Sum of price * size over sum of size, rounded half up to 4 places; null without volume."""
    s = size if keep is None else F.when(keep, size)
    return half_up(F.when(F.sum(s) > 0, F.sum(price * s) / F.sum(s)), 4)


def trade_vwap(trades: DataFrame, keys: list[str]) -> DataFrame:
    return trades.groupBy(*keys).agg(vwap(F.col("price"), F.col("size")).alias("vwap"), F.count("*").alias("trade_count"), F.round(F.sum("size")).cast("long").alias("total_volume"))


def tiered_vwap(trades: DataFrame, keys: list[str], age_s: Column, hours: tuple[int, ...] = TIER_HOURS, least: int = LEAST_TRADES) -> DataFrame:
    """Average over the first window with at least `least` trades: tier 1 for the shortest, 2 for others; tier 3 and all trades of the longest window if none has.  One pass."""
    recent = trades.withColumn("_age", age_s).filter((F.col("_age") >= 0) & (F.col("_age") <= hours[-1] * 3600))
    within = {h: F.col("_age") <= h * 3600 for h in hours}
    one = [F.struct(F.count(F.when(k, 1)).alias("n"), vwap(F.col("price"), F.col("size"), k).alias("vwap"), F.round(F.sum(F.when(k, F.col("size")))).cast("long").alias("volume")).alias(f"_w{h}") for h, k in within.items()]
    out = recent.groupBy(*keys).agg(*one)
    first = F.coalesce(*[F.when(F.col(f"_w{h}.n") >= least, F.lit(h)) for h in hours])
    pick = lambda field: F.coalesce(*[F.when(F.col(f"_w{h}.n") >= least, F.col(f"_w{h}.{field}")) for h in hours], F.col(f"_w{hours[-1]}.{field}"))
    tier = F.when(first == hours[0], 1).when(first.isNotNull(), 2).otherwise(3)
    return out.select(*keys, pick("vwap").alias("vwap"), first.alias("window_hours"), pick("n").alias("trade_count"), pick("volume").alias("volume"), tier.alias("tier"))


def cross_venue(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Volume-weighted price of two venues (vwap, volume, midpoint each); without volume the first venue's midpoint, then the other's."""
    a = left.select(key, F.col("vwap").alias("va"), F.col("volume").alias("na"), F.col("midpoint").alias("ma"))
    b = right.select(key, F.col("vwap").alias("vb"), F.col("volume").alias("nb"), F.col("midpoint").alias("mb"))
    both = a.join(b, key, "full_outer")
    weigh = lambda v, n: F.when(F.col(v).isNotNull() & (F.col(n) > 0), F.col(n)).otherwise(0)
    wa, wb = weigh("va", "na"), weigh("vb", "nb")
    price = half_up((F.coalesce("va", F.lit(0.0)) * wa + F.coalesce("vb", F.lit(0.0)) * wb) / F.nullif(wa + wb, F.lit(0)), 4)
    return both.select(key, F.coalesce(price, "ma", "mb").alias("price"), (wa + wb).cast("long").alias("volume"))


def candle_price(close: Column, previous: Column, bid: Column, ask: Column) -> Column:
    """Cents to probability: close, else previous close, else mid of bid and ask, else ask, else bid."""
    return F.coalesce(close, previous, (bid + ask) / 2, ask, bid) / 100


def quote_price(bid: Column, ask: Column, last: Column) -> Column:
    """(bid + ask) / 200 where there is a bid, else last / 100."""
    return F.when((bid > 0) & ask.isNotNull(), (bid + ask) / 200).otherwise(last / 100)
