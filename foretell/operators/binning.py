"""Bins, histograms and empirical distributions with the edge rules of NumPy and pandas."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretell.operators.ranks import global_rank, quantiles
from foretell.operators.scan import running


def equal_count_bins(df: DataFrame, value: str, tie: str, k: int | None = None, out: str = "bin") -> DataFrame:
    """Bins of floor(n / k) rows in value order, the last one takes the rest.  k: n / 160 held to 20..100 by default."""
    n = df.filter(F.col(value).isNotNull()).count()
    k = k or max(20, min(100, n // 160))
    size = max(1, n // k)
    return global_rank(df, value, tie, "_rank").withColumn(out, F.least(F.floor((F.col("_rank") - 1) / size), F.lit(k - 1)).cast("int")).drop("_rank")


def calibration(df: DataFrame, bins: str, p: str, outcome: str) -> DataFrame:
    return df.groupBy(bins).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(outcome).alias("mean_outcome"))


def edge_bin(value: Column, edges: Column) -> Column:
    """Number of the right-closed bin between sorted edges, from 0, the first edge included; null outside."""
    below = F.size(F.filter(edges, lambda e: e < value))
    inside = (value >= F.element_at(edges, 1)) & (value <= F.element_at(edges, -1))
    return F.when(inside, F.greatest(below - 1, F.lit(0)))


def quantile_bins(df: DataFrame, value: str, q: int, out: str = "bin") -> DataFrame:
    """Bins at exact linear-interpolated quantiles, duplicate edges dropped."""
    edges = sorted(set(quantiles(df, value, [k / q for k in range(q + 1)])))
    return df.withColumn(out, edge_bin(F.col(value), F.array(*map(F.lit, edges))) if edges else F.lit(None).cast("int"))


def linspace(low: Column, high: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: F.when(i == k, high).otherwise(low + i * ((high - low) / k)))


def equal_width_bins(df: DataFrame, value: str, k: int, out: str = "bin") -> DataFrame:
    """k right-closed bins between the smallest and the largest value, the smallest included."""
    edges = df.select(linspace(F.min(value), F.max(value), k).alias("_edges"))
    return df.crossJoin(F.broadcast(edges)).withColumn(out, edge_bin(F.col(value), F.col("_edges"))).drop("_edges")


def cut(value: Column, edges: list[float], include_lowest: bool = False) -> Column:
    """Right-closed bin number between explicit edges; the lowest edge only if asked for."""
    n = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < value)) - 1
    n = F.when(F.lit(include_lowest) & (value == edges[0]), 0).otherwise(n)
    return F.when((value > edges[-1]) | (n < 0), None).otherwise(n)


def histogram(df: DataFrame, value: str, k: int, low: float, high: float) -> DataFrame:
    """Counts of k bins over a fixed range: left-closed, the last one closed on both sides; values outside are ignored; empty bins are zero."""
    x = F.col(value)
    width = (high - low) / k
    edge = lambda n: F.lit(low) + n * F.lit(width)
    guess = F.floor((x - low) / width)
    # the division may be off by one rounding at an edge, which is put right against the edges themselves
    right = F.when(x < edge(guess), guess - 1).when((x >= edge(guess + 1)) & (guess + 1 < k), guess + 1).otherwise(guess)
    bins = F.least(right, F.lit(k - 1)).cast("int")
    counts = df.filter(x.between(low, high)).groupBy(bins.alias("bin")).agg(F.count("*").alias("n"))
    spine = df.sparkSession.range(k).select(F.col("id").cast("int").alias("bin"))
    return spine.join(F.broadcast(counts), "bin", "left").na.fill(0, ["n"])


def log_histogram(df: DataFrame, value: str, k: int, low: float, high: float) -> DataFrame:
    """Counts of k bins of equal width in the logarithm over a fixed range: values outside are clipped to it, those not above zero are ignored; edges, empty bins are zero."""
    clipped = F.least(F.greatest(F.log10(value), F.lit(math.log10(low))), F.lit(math.log10(high)))
    counts = histogram(df.filter(F.col(value) > 0).select(clipped.alias("x")), "x", k, math.log10(low), math.log10(high))
    edge = lambda n: F.pow(F.lit(10.0), F.lit(math.log10(low)) + n * ((math.log10(high) - math.log10(low)) / k))
    return counts.select("bin", edge(F.col("bin")).alias("from"), edge(F.col("bin") + 1).alias("to"), "n")


def ecdf(df: DataFrame, value: str, tie: str, out: str = "cdf") -> DataFrame:
    """rank / n in value order (each row its own step)."""
    n = df.select(F.count(value).alias("_n"))
    return global_rank(df, value, tie, "_r").crossJoin(F.broadcast(n)).withColumn(out, F.col("_r") / F.col("_n")).drop("_r", "_n")


def z_score(df: DataFrame, value: str, by: str | None = None, out: str = "z") -> DataFrame:
    """(x - mean) / sample deviation, over the table or each group (then with 1e-10 added to the deviation)."""
    x = F.col(value)
    if by is None:
        m = df.select(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
        return df.crossJoin(F.broadcast(m)).withColumn(out, F.try_divide(x - F.col("_m"), F.col("_s"))).drop("_m", "_s")
    m = df.groupBy(F.col(by).alias("_g")).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return df.join(m, F.col(by) == F.col("_g"), "left").withColumn(out, (x - F.col("_m")) / (F.col("_s") + 1e-10)).drop("_g", "_m", "_s")


def residual(df: DataFrame, value: str, bins: str, out: str = "residual") -> DataFrame:
    """value minus the mean of its bin."""
    m = df.groupBy(F.col(bins).alias("_g")).agg(F.avg(value).alias("_m"))
    return df.join(m, F.col(bins) == F.col("_g")).withColumn(out, F.col(value) - F.col("_m")).drop("_g", "_m")


def life_fraction(df: DataFrame, key: str, ts: str, out: str = "life") -> DataFrame:
    """(t - first) / (last - first) of each key, span 1 if zero.  First and last are aggregated before the shuffle and joined back; no key is a task."""
    ends = df.groupBy(F.col(key).alias("_key")).agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"))
    span = F.col("_last") - F.col("_first")
    return df.join(ends, F.col(key).eqNullSafe(F.col("_key"))).withColumn(out, (F.col(ts) - F.col("_first")) / F.when(span == 0, 1).otherwise(span)).select(*df.columns, out)


def paired_calibration(df: DataFrame, by: str, first: str, second: str, outcome: str, tie: str, k: int = 20, least: int = 50) -> DataFrame:
    """Two predictions of the same rows, calibrated over the same bins: by, bin, n, mean of each and of the outcome.

    Bins are of floor(n / k) rows in the order of the first prediction (ties by `tie`), the last one takes the rest; rows that lack a value and groups of fewer than `least` rows are left out.  Ranks of all groups come from one segmented scan.
    """
    rows = df.filter(F.col(first).isNotNull() & F.col(second).isNotNull() & F.col(outcome).isNotNull()).select(by, first, second, outcome, tie)
    ranked = running(rows, [by], [first, tie], totals={"_rank": F.lit(1)}, wholes={"_n": F.lit(1)}).filter(F.col("_n") >= least)
    bins = F.least(F.floor((F.col("_rank") - 1) / F.greatest(F.lit(1), F.floor(F.col("_n") / k))), F.lit(k - 1)).cast("int")
    return ranked.groupBy(by, bins.alias("bin")).agg(F.count("*").alias("n"), F.avg(first).alias(f"mean_{first}"), F.avg(second).alias(f"mean_{second}"), F.avg(outcome).alias("mean_outcome"))


def duration_days(df: DataFrame, key: str, ts: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"), F.when(F.count("*") >= 2, (F.max(ts) - F.min(ts)) / 86400).otherwise(0.0).alias("days"))
