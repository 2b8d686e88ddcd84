"""Forecast scores and their slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foretell.functions.numbers import corr, p_value
from foretell.operators.ranks import global_rank, group_medians

EPS = 1e-15


def brier(p: Column, outcome: Column) -> Column:
    return (p - outcome) * (p - outcome)


def log_loss(p: Column, outcome: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    return -(outcome * F.log(q) + (1 - outcome) * F.log(1 - q))


def accuracy_of(p: Column, outcome: Column) -> Column:
    """Mean of right calls; a price of one half is no call."""
    return F.avg(F.when(p > 0.5, outcome.cast("double")).when(p < 0.5, 1.0 - outcome))


def scores(df: DataFrame, keys: list[str]) -> DataFrame:
    """n, brier, log_loss, mae and accuracy by keys; rows without price or outcome are left out."""
    p, o = F.col("p"), F.col("outcome")
    valid = df.filter(p.isNotNull() & o.isNotNull())
    return valid.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(brier(p, o)).alias("brier"), F.avg(log_loss(p, o)).alias("log_loss"), F.avg(F.abs(p - o)).alias("mae"), accuracy_of(p, o).alias("accuracy"))


def directional_accuracy(predictions: DataFrame, key: str, horizon: str) -> DataFrame:
    """Share of right calls over each key's row with the smallest horizon."""
    last = predictions.groupBy(key).agg(F.min_by(F.struct("p", "outcome"), horizon).alias("x"))
    return last.agg(accuracy_of(F.col("x.p"), F.col("x.outcome")).alias("accuracy"), F.count(F.when(F.col("x.p") != 0.5, 1)).alias("n"))


def volume_weighted(df: DataFrame, keys: list[str], value: Column, weight: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight))).alias("weighted"), F.avg(value).alias("plain"), F.count(value).alias("n"))


def with_total(df: DataFrame, key: str, aggs: list[Column], label: str = "ALL") -> DataFrame:
    """Aggregates by key and a total row, in one rollup."""
    return df.filter(F.col(key).isNotNull()).rollup(key).agg(*aggs, F.grouping(key).alias("_total")).withColumn(key, F.when(F.col("_total") == 1, F.lit(label)).otherwise(F.col(key))).drop("_total")


def cohorts(predictions: DataFrame, key: str, horizon: str, extra: list[str] | None = None) -> DataFrame:
    """Cohort h: keys that have horizon h; mean Brier at every horizon up to h, overall and by each extra column, in one pass of grouping sets."""
    extra = extra or []
    member = predictions.select(key, F.col(horizon).alias("cohort")).distinct()
    joined = predictions.join(member, key).filter(F.col(horizon) <= F.col("cohort"))
    sets = [["cohort", horizon], *[["cohort", horizon, *extra[: i + 1]] for i in range(len(extra))]]
    score = joined.withColumn("b", brier(F.col("p"), F.col("outcome")))
    return score.groupingSets([[F.col(c) for c in s] for s in sets], "cohort", horizon, *extra).agg(F.avg("b").alias("brier"), F.countDistinct(key).alias("n"))


def pivot_counts(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    return df.groupBy(row).pivot(column, values).count().na.fill(0)


def monthly_pivot(df: DataFrame, rows: list[str], month: Column, values: list[str], amount: str) -> DataFrame:
    """Sum of amount by rows and month name, missing months zero."""
    return df.withColumn("_month", month).groupBy(*rows).pivot("_month", values).agg(F.sum(amount)).na.fill(0.0)


def attribute_table(df: DataFrame, key: str, metrics: dict[str, Column], medians: dict[str, str] | None = None) -> DataFrame:
    """One row per metric and key, from one aggregation; `medians` names columns whose median is a metric too."""
    wide = df.groupBy(key).agg(*[m.cast("double").alias(n) for n, m in metrics.items()])
    if medians:
        found = group_medians(df, list(medians.values()), [key]).select(F.col(key).alias("_key"), *[F.col(f"{c}_median").alias(n) for n, c in medians.items()])
        wide = wide.join(found, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    return wide.unpivot([key], [*metrics, *(medians or {})], "metric", "value")


def head_to_head(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Wins (lower Brier), ties, mean difference, Pearson r, and the paired t statistic with its two-sided p, of two panels (key, brier)."""
    both = a.select(key, F.col("brier").alias("x")).join(b.select(key, F.col("brier").alias("y")), key)
    d = F.col("x") - F.col("y")
    out = both.agg(F.count("*").alias("n"), F.count_if(d < 0).alias("a_wins"), F.count_if(d > 0).alias("b_wins"), F.count_if(d == 0).alias("ties"), F.avg(d).alias("mean_diff"), corr("x", "y").alias("r"), F.try_divide(F.avg(d), F.stddev_samp(d) / F.sqrt(F.count("*"))).alias("t"))
    return out.withColumn("p_value", p_value(F.col("t"), F.col("n") - 1))


def consensus(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Brier of the mean of two venues' probabilities next to each venue's own (key, p, outcome)."""
    both = a.select(key, F.col("p").alias("x"), "outcome").join(b.select(key, F.col("p").alias("y")), key)
    o = F.col("outcome")
    return both.agg(F.count("*").alias("n"), F.avg(brier(F.col("x"), o)).alias("a"), F.avg(brier(F.col("y"), o)).alias("b"), F.avg(brier((F.col("x") + F.col("y")) / 2, o)).alias("both"))


def classification(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1."""
    c = lambda k: F.count_if(k)
    m = df.agg(c(predicted & actual).alias("tp"), c(predicted & ~actual).alias("fp"), c(~predicted & actual).alias("fn"), c(~predicted & ~actual).alias("tn"))
    m = m.withColumn("accuracy", F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))
    return m.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def concentration(df: DataFrame, key: str, amount: str, tops: dict[str, float]) -> DataFrame:
    """Share of the total held by the largest fractions of keys (at least one key each)."""
    per = df.groupBy(key).agg(F.sum(amount).alias("v"))
    total = per.agg(F.count("*").alias("n"), F.sum("v").alias("all"))
    ranked = global_rank(per, "v", key, "rank", descending=True)  # equal amounts are alike, so their order does not matter
    shares = [(F.sum(F.when(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("n") * share)), F.col("v"))) / F.max("all")).alias(name) for name, share in tops.items()]
    return ranked.crossJoin(F.broadcast(total)).agg(F.max("n").alias("n"), *shares)


def share_curve(df: DataFrame, key: str, amount: str, points: int = 100) -> DataFrame:
    """Share of the total held by the largest k of `points` equal parts of the keys, for every k: the rank curve and, read from the other side, the distribution function of amounts over keys."""
    per = df.groupBy(key).agg(F.sum(amount).alias("v"))
    n = per.select(F.count("v").alias("n"))
    ranked = global_rank(per, "v", key, "rank", descending=True).crossJoin(F.broadcast(n))
    parts = ranked.groupBy(F.ceil(F.col("rank") * points / F.col("n")).cast("int").alias("part")).agg(F.count("*").alias("keys"), F.sum("v").alias("v"))
    up = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)  # `points` rows at most
    return parts.select("part", F.sum("keys").over(up).alias("keys"), (F.sum("v").over(up) / F.sum("v").over(Window.partitionBy())).alias("share"))
