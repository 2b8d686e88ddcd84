"""Order books as sorted arrays of (price, size): bids from the highest price, asks from the lowest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretell.operators.ranks import group_medians, quantiles

LEVELS = "array<struct<price:double,size:double>>"
MOVE = 0.05


def _level(price: Column, size: Column) -> Column:
    return F.struct(price.cast("double").alias("price"), size.cast("double").alias("size"))


def _sorted(levels: Column, descending: bool) -> Column:
    ok = F.filter(levels, lambda x: (x.price > 0) & (x.size > 0))
    out = F.array_sort(ok)
    return F.reverse(out) if descending else out


def from_cents(yes: Column, no: Column) -> tuple[Column, Column]:
    """Bids and asks from two arrays of [cents, quantity]: yes gives bids, no gives asks at one minus its price."""
    bids = F.transform(yes, lambda x: _level(F.element_at(x, 1) / 100, F.element_at(x, 2)))
    asks = F.transform(no, lambda x: _level(1 - F.element_at(x, 1) / 100, F.element_at(x, 2)))
    return _sorted(bids, True), _sorted(asks, False)


def from_strings(levels: Column, descending: bool) -> Column:
    """Levels from structs of text with price or p, size or s; what is not a number is dropped."""
    pick = lambda x, a, b: F.coalesce(x[a], x[b]).try_cast("double")
    return _sorted(F.transform(levels, lambda x: _level(pick(x, "price", "p"), pick(x, "size", "s"))), descending)


def build(levels: DataFrame, keys: list[str], bid: Column, price: str, size: str) -> DataFrame:
    """Books from one row per level: bids and asks by keys; equal prices of a side are one level."""
    merged = levels.groupBy(*keys, bid.alias("_bid"), F.col(price).alias("_p")).agg(F.sum(size).alias("_s"))
    side = lambda k: F.collect_list(F.when(k, _level(F.col("_p"), F.col("_s"))))
    out = merged.groupBy(*keys).agg(side(F.col("_bid")).alias("bids"), side(~F.col("_bid")).alias("asks"))
    return out.withColumn("bids", _sorted(F.col("bids"), True)).withColumn("asks", _sorted(F.col("asks"), False))


def _depth(levels: Column) -> Column:
    return F.aggregate(levels, F.lit(0.0), lambda s, x: s + x.size)


def metrics(books: DataFrame) -> DataFrame:
    """Best prices and sizes, spread, midpoint, relative spread, depths and level counts; null where a side is empty."""
    best = lambda c: F.try_element_at(F.col(c), F.lit(1))
    out = books.withColumn("best_bid", best("bids").price).withColumn("best_ask", best("asks").price).withColumn("best_bid_size", best("bids").size).withColumn("best_ask_size", best("asks").size)
    out = out.withColumn("spread", F.col("best_ask") - F.col("best_bid")).withColumn("midpoint", (F.col("best_ask") + F.col("best_bid")) / 2)
    out = out.withColumn("relative_spread", F.try_divide("spread", "midpoint")).withColumn("bid_depth", _depth(F.col("bids"))).withColumn("ask_depth", _depth(F.col("asks")))
    return out.withColumn("total_depth", F.col("bid_depth") + F.col("ask_depth")).withColumn("n_bid_levels", F.size("bids")).withColumn("n_ask_levels", F.size("asks"))


def _walk(levels: Column, sign: int) -> Column:
    """Value of the levels strictly inside the move; null if the book ends before the target."""
    target = F.element_at(levels, 1).price + sign * MOVE
    inside = lambda x: (x.price - target) * sign < 0
    value = F.aggregate(F.filter(levels, inside), F.lit(0.0), lambda s, x: s + x.price * x.size)
    return F.when((F.size(levels) > 0) & F.exists(levels, lambda x: ~inside(x)), F.floor(value + 0.5))


def cost_to_move(bids: Column, asks: Column) -> Column:
    """Dollars that move the price by five cents in the cheaper direction."""
    up, down = (F.when(F.size(c) > 0, _walk(c, s)) for c, s in ((asks, 1), (bids, -1)))
    return F.least(up, down)


def price_impact(asks: Column, midpoint: Column, dollars: float) -> Column:
    """What a purchase of that many dollars does: cents from the midpoint to the last price touched, shares, levels and dollars spent."""
    start = F.struct(F.lit(float(dollars)).alias("left"), F.lit(0.0).alias("shares"), F.lit(0).alias("levels"), midpoint.alias("last"))

    def take(s: Column, x: Column) -> Column:
        cost = F.least(s.left, x.price * x.size)
        more = F.struct((s.left - cost).alias("left"), (s.shares + cost / x.price).alias("shares"), (s.levels + 1).alias("levels"), x.price.alias("last"))
        return F.when(s.left > 0, more).otherwise(s)

    done = lambda s: F.struct(F.round((s["last"] - midpoint) * 100, 2).alias("impact_cents"), F.floor(s.shares + 0.500001).alias("shares"), s.levels.alias("levels"), (dollars - s.left).alias("spent"))
    return F.when(F.size(asks) > 0, F.aggregate(asks, start, take, done))


def grade(cost: Column, tier: Column) -> Column:
    """fragile, caution or robust by cost (10,000 and 100,000); tier 2 lowers by one, tier 3 is fragile."""
    base = F.when(cost.isNull() | (cost < 10_000), 0).when(cost < 100_000, 1).otherwise(2)
    level = F.when(tier == 3, 0).when(tier == 2, F.greatest(base - 1, F.lit(0))).otherwise(base)
    return F.element_at(F.array(F.lit("fragile"), F.lit("caution"), F.lit("robust")), level + 1)


def weakest(a: Column, b: Column, names: tuple[str, str] = ("polymarket", "kalshi")) -> Column:
    """The smaller cost of two venues and whose it is; nulls do not count."""
    venue = F.when(a.isNull() & b.isNull(), None).when(b.isNull() | (a <= b), names[0]).otherwise(names[1])
    return F.struct(F.least(a, b).alias("cost"), venue.alias("venue"))


def combined_midpoint(bids: list[Column], asks: list[Column]) -> Column:
    top = F.array_max(F.concat(*[F.transform(b, lambda x: x.price) for b in bids]))
    low = F.array_min(F.concat(*[F.transform(a, lambda x: x.price) for a in asks]))
    return F.round((top + low) / 2, 4)


def combined_midpoints(books: DataFrame, keys: list[Column]) -> DataFrame:
    """Midpoint of the best bid and the best ask over all books of a group; no book leaves its task whole."""
    best = lambda f, side: f(F.transform(side, lambda x: x.price))
    g = books.groupBy(*keys).agg(F.max(best(F.array_max, "bids")).alias("top"), F.min(best(F.array_min, "asks")).alias("low"))
    return g.withColumn("midpoint", F.round((F.col("top") + F.col("low")) / 2, 4)).drop("top", "low")


def upper_median(value: str) -> Column:
    """The middle value, of an even number the larger of the two."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC)")


def liquidity(snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """Spread, relative spread (%), depth, imbalance and price statistics of snapshots; deviations are population ones.  Medians come from one scan of all three."""
    b, a = F.col("bid_depth"), F.col("ask_depth")
    rows = snapshots.withColumn("_rel", F.col("relative_spread") * 100)
    some = lambda c, k, name: [F.avg(c).alias(f"{name}_mean"), F.stddev_pop(c).alias(f"{name}_std"), *[f(c).alias(f"{name}_{n}") for n, f in k]]
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n_snapshots"), *some("spread", [("min", F.min), ("max", F.max)], "spread"), *some("_rel", [], "rel_spread"), *some("total_depth", [("max", F.max)], "depth"),
        F.avg(b).alias("bid_depth_mean"), F.avg(a).alias("ask_depth_mean"), F.avg(F.when(b + a > 0, (b - a) / (b + a)).when((b + a).isNotNull(), 0.0)).alias("imbalance_mean"), F.avg("midpoint").alias("price_mean"), F.stddev_pop("midpoint").alias("price_std"),
    )
    medians = group_medians(rows, ["spread", "_rel", "total_depth"], keys).withColumnsRenamed({"_rel_median": "rel_spread_median", "total_depth_median": "depth_median"} | {k: f"_{k}" for k in keys})
    return out.join(medians, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*[f"_{k}" for k in keys])


def robustness(graded: DataFrame) -> DataFrame:
    """Counts of grades, assessed and not (a market without a cost is fragile)."""
    is_ = lambda g: F.count_if(F.col("grade") == g).alias(g)
    return graded.agg(F.count("*").alias("markets"), F.count("cost").alias("assessed"), is_("robust"), is_("caution"), is_("fragile")).crossJoin(F.broadcast(_one_median(graded, "cost")))


def _one_median(df: DataFrame, value: str) -> DataFrame:
    """One row: the median of a column."""
    found = quantiles(df, value, [0.5])
    return df.sparkSession.range(1).select(F.lit(found[0] if found else None).cast("double").alias(f"median_{value}"))
