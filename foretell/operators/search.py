"""Listing, search, ranked views and samples of markets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MOST = 200


def contains_all(query: str, fields: list[Column]) -> Column:
    """Every word of the query is somewhere in the fields."""
    hay = F.lower(F.concat_ws(" ", *fields))
    return F.forall(F.split(F.lit(query.lower().strip()), r"\s+"), lambda w: F.contains(hay, w))


def contains_any(query: str, fields: list[Column]) -> Column:
    """The query is inside at least one field."""
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(F.contains(F.lower(f), F.lit(query.lower())), F.lit(False))
    return hit


def reportable(markets: DataFrame, costs: DataFrame, key: str, cost: str) -> DataFrame:
    """Markets that have a cost to move, with it, dearest first (ties by key)."""
    return markets.join(costs.select(key, cost), key).orderBy(F.desc(cost), key)


def page(df: DataFrame, equal: dict[str, str], order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    for c, v in equal.items():
        df = df.filter(F.col(c) == v)
    return df.orderBy(*order).offset(offset).limit(min(limit, MOST))


def by_slug(df: DataFrame, slug: str, wanted: str, order: list[Column]) -> DataFrame:
    """The first row with a slug, in any case; none if there is none.  The slug reaches the scan as a filter."""
    return df.filter(F.lower(slug) == wanted.lower()).orderBy(*order).limit(1)


def biggest_moves(df: DataFrame, change: str, volume: str, tie: str, least_volume: float, k: int) -> DataFrame:
    """Largest abs(change) * log10(volume) ** 3 among markets with enough volume."""
    score = F.abs(change) * F.pow(F.log10(F.greatest(F.col(volume), F.lit(1.0))), 3)
    return df.filter((F.col(volume) >= least_volume) & F.col(change).isNotNull()).withColumn("score", score).orderBy(F.desc("score"), tie).limit(k)


def highest_volume(df: DataFrame, slug: str, volume: str, tie: str, k: int) -> DataFrame:
    """Largest markets, one per slug."""
    best = df.groupBy(slug).agg(F.max_by(F.struct(*[c for c in df.columns if c != slug]), F.struct(volume, -F.col(tie))).alias("x")).select(slug, "x.*")
    return best.orderBy(F.desc(volume), tie).limit(k)


def divergences(a: DataFrame, b: DataFrame, key: str, value: str, least: float = 0.05) -> DataFrame:
    """Keys of both sides whose values lie further apart than `least` (by more than rounding), widest first."""
    both = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key)
    return both.withColumn("spread", F.abs(F.col("a") - F.col("b"))).filter(F.col("spread") > least + 1e-9).orderBy(F.desc("spread"), key)


def tiers(df: DataFrame, volume: str, tie: str, first: int = 50, second: int = 500) -> DataFrame:
    """Tier 1 for the first markets by volume, 2 for the next; others are left out."""
    top = df.orderBy(F.desc(volume), tie).limit(first + second)
    return top.withColumn("tier", F.when(F.row_number().over(Window.orderBy(F.desc(volume), tie)) <= first, 1).otherwise(2))  # bounded by the limit


def top_groups(df: DataFrame, group: str, amount: str, k: int, always: list[str] = ()) -> DataFrame:
    """Rows of the k groups with the largest sum, and of groups asked for by name."""
    top = df.groupBy(group).agg(F.sum(amount).alias("_t")).orderBy(F.desc("_t"), group).limit(k).select(group)
    named = df.sparkSession.createDataFrame([(g,) for g in always], f"{group} string") if always else top.limit(0)
    return df.join(F.broadcast(top.union(named).distinct()), group, "left_semi")


def seeded(key: str, seed: int) -> Column:
    """Digest of a seed and a key, in hexadecimal."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The n rows with the smallest seeded digest: the same rows on every run, in any partitioning and engine."""
    return df.orderBy(seeded(key, seed), key).limit(n)


def stratified(df: DataFrame, by: str, key: str, n: int, seed: int = 42) -> DataFrame:
    w = Window.partitionBy(by).orderBy(seeded(key, seed), key)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def split(df: DataFrame, key: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """df with `train`: all rows of a key on one side."""
    return df.withColumn("train", F.conv(F.substring(seeded(key, seed), 1, 7), 16, 10).cast("long") % 1000 < int(share * 1000))
