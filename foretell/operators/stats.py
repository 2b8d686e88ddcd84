"""Statistics and models: densities, correlations, bootstrap, least squares, searches and the specification curve."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foretell.functions.numbers import corr, p_value, t_quantile, t_two_sided
from foretell.operators.ranks import average_rank, group_quantiles, rank_pct
from foretell.operators.scoring import brier, log_loss
from foretell.operators.search import split
from foretell.sources.shared import shared_dir, written


def kde(df: DataFrame, value: str, points: int = 200, low: float = 0.0, high: float = 100.0) -> DataFrame:
    """Gaussian density on a grid with Scott's bandwidth; zeros where the deviation is at most 0.01; no row without values.

    Equal values are counted first; a task adds its values into one array of `points` sums, so values never multiply and a task hands on `points` rows.
    """
    per = written(df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c")))
    mean = F.sum(F.col("v") * F.col("c")) / F.sum("c")
    n, middle = per.agg(F.sum("c"), mean).first()
    grid = np.array([low + i * ((high - low) / (points - 1)) for i in range(points)])
    if not n:
        return df.sparkSession.createDataFrame([], "x double, density double")
    squares = per.agg(F.sum(F.col("c") * (F.col("v") - F.lit(middle)) * (F.col("v") - F.lit(middle)))).first()[0]
    sd = math.sqrt(squares / (n - 1)) if n > 1 else 0.0
    width = sd * n**-0.2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(points)
        for b in batches:
            v, c = b.column("v").to_numpy(), b.column("c").to_numpy()
            for k in range(0, len(v), 4096):
                u = (grid[:, None] - v[None, k : k + 4096]) / width
                sums += np.exp(-u * u / 2) @ c[k : k + 4096]
        yield pa.RecordBatch.from_arrays([pa.array(grid), pa.array(sums)], ["x", "s"])

    if sd <= 0.01:
        return df.sparkSession.createDataFrame([(float(x), 0.0) for x in grid], "x double, density double")
    return per.mapInArrow(run, "x double, s double").groupBy("x").agg((F.sum("s") / F.lit(n * width * math.sqrt(2 * math.pi))).alias("density"))


def correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    return df.agg(*[corr(a, b).alias(f"{a}_{b}") for a, b in pairs])


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation over rows with both values, its t statistic and two-sided p."""
    rows = written(df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b))
    ranked = average_rank(average_rank(rows, a, "_ra"), b, "_rb")
    r = ranked.agg(corr("_ra", "_rb").alias("rho"), F.count("*").alias("n"))
    return r.withColumn("t", F.col("rho") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("rho") * F.col("rho")))).withColumn("p_value", p_value(F.col("t"), F.col("n") - 2))


def bootstrap_mean(df: DataFrame, value: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Poisson bootstrap of the mean: its mean and 2.5 / 97.5 % limits over the replicates.

    Equal values are counted first.  The weight of a value with c rows in a replicate is the sum of c draws of Poisson(1), which is one draw of Poisson(c); it is drawn from a generator seeded by (seed, value), for all replicates at once.  Tasks add weights and weighted values into two arrays of `replicates` sums, so no row is multiplied and a task hands on two arrays.
    """
    per = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, sums = np.zeros(replicates), np.zeros(replicates)
        for b in batches:
            for v, c in zip(b.column("v").to_numpy(), b.column("c").to_numpy()):
                drawn = np.random.Generator(np.random.PCG64([seed, *np.frombuffer(np.float64(v).tobytes(), np.uint32).tolist()])).poisson(c, replicates)
                weights += drawn
                sums += drawn * v
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates)), pa.array(weights), pa.array(sums)], ["r", "w", "s"])

    means = per.mapInArrow(run, "r long, w double, s double").groupBy("r").agg(F.try_divide(F.sum("s"), F.sum("w")).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))  # `replicates` rows


def ols(df: DataFrame, y: str, xs: list[str], cluster: str | None = None) -> DataFrame:
    """Least squares with intercept: term, coef, se, t, two-sided p_value, 95 % limits low and high, and r2, n.  With `cluster`, standard errors are clustered (factor G/(G-1) * (N-1)/(N-K)).  Cross products are one aggregation; only K by K sums reach the driver, score sums of clusters stay distributed."""
    spark = df.sparkSession
    rows = df.select(F.col(y).cast("double").alias("_y"), F.lit(1.0).alias("_x0"), *[F.col(x).cast("double").alias(f"_x{i}") for i, x in enumerate(xs, 1)], *([F.col(cluster).alias("_g")] if cluster else [])).dropna()
    k = len(xs) + 1
    cols = [f"_x{i}" for i in range(k)] + ["_y"]
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    sums = rows.agg(F.count("*").alias("n"), *[F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"s{i}_{j}") for i, j in pairs]).first()
    full = np.zeros((k + 1, k + 1))
    for i, j in pairs:
        full[i, j] = full[j, i] = sums[f"s{i}_{j}"] or 0.0
    n, xx, xy, yy = sums["n"], full[:k, :k], full[:k, k], full[k, k]
    kinds = "term string, coef double, se double, t double, p_value double, low double, high double, r2 double, n long"
    if not n:
        return spark.createDataFrame([], kinds)
    inverse = np.linalg.pinv(xx)
    beta = inverse @ xy
    rss = yy - beta @ xy
    spread = yy - xy[0] ** 2 / n
    r2 = float(1 - rss / spread) if spread > 0 else None
    names = ["intercept", *xs]
    if n <= k:  # no rows are left to tell errors from
        return spark.createDataFrame([(name, float(b), None, None, None, None, None, r2, int(n)) for name, b in zip(names, beta)], kinds)
    if cluster:
        error = F.col("_y") - sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta, cols)), F.lit(0.0))
        score = rows.groupBy("_g").agg(*[F.sum(error * F.col(c)).alias(c) for c in cols[:k]])
        got = score.agg(F.count("*").alias("g"), *[F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"s{i}_{j}") for i in range(k) for j in range(k)]).first()
        meat = np.array([[got[f"s{i}_{j}"] for j in range(k)] for i in range(k)])
        cov = got["g"] / (got["g"] - 1) * (n - 1) / (n - k) * inverse @ meat @ inverse
    else:
        cov = inverse * rss / (n - k)
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    freedom = got["g"] - 1 if cluster else n - k
    reach = t_quantile(0.95, freedom)
    data = [(name, float(b), float(s), float(b / s) if s else None, t_two_sided(float(b / s), freedom) if s else None, float(b - reach * s), float(b + reach * s), r2, int(n)) for name, b, s in zip(names, beta, se)]
    return spark.createDataFrame(data, kinds)


def dummies(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """0/1 columns for all levels but the first."""
    return df.withColumns({f"{column}_{v}": (F.col(column) == v).cast("int") for v in levels[1:]})


def fit_lines(df: DataFrame, x: str, y: str) -> DataFrame:
    """Straight line and power law (on positive values)."""
    positive = (F.col(x) > 0) & (F.col(y) > 0)
    lx, ly = (F.when(positive, F.log(F.when(positive, F.col(c)))) for c in (x, y))
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_slope(ly, lx).alias("power"), F.regr_intercept(ly, lx).alias("log_scale"))


def weight_search(df: DataFrame, a: str, b: str, target: str, steps: int = 20) -> DataFrame:
    """The pair of weights of a and b on a steps x steps grid over 0..1, scaled to sum to 1, whose weighted sum correlates least with target.

    A correlation of a weighted sum follows from the six second moments of a, b and target, so the rows are read once, whatever the grid.  Ties go to the smaller weight of a, then of b, before scaling.
    """
    m = df.select(F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"), F.col(target).cast("double").alias("_t")).dropna()
    m = m.agg(F.covar_pop("_a", "_t").alias("at"), F.covar_pop("_b", "_t").alias("bt"), F.covar_pop("_a", "_b").alias("ab"), F.var_pop("_a").alias("aa"), F.var_pop("_b").alias("bb"), F.var_pop("_t").alias("tt"))
    grid = [(i / (steps - 1), j / (steps - 1)) for i in range(steps) for j in range(steps) if i or j]
    cells = m.withColumn("_w", F.explode(F.array(*[F.struct(F.lit(x).alias("given_a"), F.lit(y).alias("given_b"), F.lit(x / (x + y)).alias("u"), F.lit(y / (x + y)).alias("v")) for x, y in grid]))).select("*", "_w.*")
    u, v = F.col("u"), F.col("v")
    corr = F.try_divide(u * F.col("at") + v * F.col("bt"), F.sqrt((u * u * F.col("aa") + 2 * u * v * F.col("ab") + v * v * F.col("bb")) * F.col("tt")))
    best = cells.withColumn("corr", F.round(corr, 12)).filter(F.col("corr").isNotNull())
    return best.agg(F.min_by(F.struct(u.alias("weight_a"), v.alias("weight_b"), "corr"), F.struct("corr", "given_a", "given_b")).alias("x")).select("x.*")


def liquidity_score(df: DataFrame, by: str, spread: str, depth: str, weights: tuple[float, float]) -> DataFrame:
    """df with `spread_pct`, `depth_pct` (percentile ranks within `by`) and `liquidity_score`: the weighted sum of 1 - spread_pct and depth_pct."""
    ranked = rank_pct(rank_pct(df, spread, "spread_pct", by=by), depth, "depth_pct", by=by)
    return ranked.withColumn("liquidity_score", weights[0] * (1 - F.col("spread_pct")) + weights[1] * F.col("depth_pct"))


def split_lift(df: DataFrame, by: str, split: str, value: str, quantile: float = 0.25, least: int = 10, side: int = 5) -> DataFrame:
    """Mean of value at or below the quantile of `split` and above, per group with enough rows on both sides."""
    q = group_quantiles(df, split, {"cut": quantile}, [by]).withColumnRenamed(by, "_g")
    low = F.col(split) <= F.col("cut")
    out = df.join(q, F.col(by) == F.col("_g")).groupBy(by, "cut").agg(F.count("*").alias("n"), F.count_if(low).alias("n_low"), F.count_if(~low).alias("n_high"), F.avg(F.when(low, F.col(value))).alias("mean_low"), F.avg(F.when(~low, F.col(value))).alias("mean_high"))
    return out.filter((F.col("n") >= least) & (F.col("n_low") >= side) & (F.col("n_high") >= side)).withColumn("lift", F.col("mean_high") - F.col("mean_low"))


def residual_brier(p: Column, outcome: Column) -> Column:
    """Brier score less what a calibrated forecast would have."""
    return brier(p, outcome) - p * (1 - p)


def specification_curve(prices: DataFrame, price_types: list[str], thresholds: list[float], venues: tuple[str, str] = ("polymarket", "kalshi"), least: int = 0) -> DataFrame:
    """Every (truncation, price type, volume threshold, metric) cell in one aggregation: score and n of both venues, the winner and the difference.

    prices: truncation, platform, volume_usd, outcome and one column per price type.  `least` drops cells with fewer rows on a side.
    """
    long = prices.unpivot(["truncation", "platform", "volume_usd", "outcome"], price_types, "price_type", "p").filter(F.col("p").isNotNull() & F.col("outcome").isNotNull())
    # a row counts once, for the highest threshold that it reaches; the few sums are then added up over the thresholds
    reached = F.array_max(F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.col("volume_usd") >= t))
    scores = {"brier": brier(F.col("p"), F.col("outcome")), "logloss": log_loss(F.col("p"), F.col("outcome"))}
    sums = long.groupBy("truncation", "price_type", reached.alias("reached"), "platform").agg(F.count("*").alias("n"), *[F.sum(s).alias(f"_{m}") for m, s in scores.items()]).filter("reached IS NOT NULL")
    cells = sums.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))).filter(F.col("reached") >= F.col("threshold"))
    cells = cells.select("truncation", "price_type", "threshold", "platform", "n", F.explode(F.create_map(*[x for m in scores for x in (F.lit(m), F.col(f"_{m}"))])).alias("metric", "s"))
    of = lambda v, c: F.sum(F.when(F.col("platform") == v, F.col(c)))
    n = lambda v: F.coalesce(of(v, "n"), F.lit(0))
    a, b = venues
    out = cells.groupBy("truncation", "price_type", "threshold", "metric").agg((of(a, "s") / of(a, "n")).alias("pm_score"), n(a).alias("pm_n"), (of(b, "s") / of(b, "n")).alias("k_score"), n(b).alias("k_n"))
    out = out.filter((F.col("pm_n") >= least) & (F.col("k_n") >= least))
    out = out.withColumn("pm_wins", F.col("pm_score") < F.col("k_score")).withColumn("score_diff", F.col("pm_score") - F.col("k_score"))
    order = Window.orderBy("truncation", "price_type", "threshold", "metric")  # at most one row per cell of the grid
    return out.withColumn("spec_id", F.row_number().over(order))


def forest_importance(df: DataFrame, key: str, features: list[str], label: str, trees: int = 20, depth: int = 6, seed: int = 42, bucket: int = 50_000) -> DataFrame:
    """Random forest on a split by key (80 / 20, all rows of a key on one side): R2 on the held-out part, and how much it falls when a feature is shuffled.

    The rows are written once.  Training rows are dealt by a hash of theirs to partitions of about `bucket` rows, in an order of their own: the forest caches a partition whole and its tasks read it again at every depth, and files would be put together to partitions of 128 MB.  Held-out rows are dealt to buckets of about `bucket` rows; within a bucket every feature's values are dealt anew in the order of a hash of its own, all features in one join, and one pass of the model gives every R2.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    spark = df.sparkSession
    at = f"{shared_dir(spark)}/forest-{uuid.uuid4().hex}"
    split(df.select(F.col(key).alias("key"), *[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("label")).dropna(), "key", seed=seed).write.parquet(at)
    rows = spark.read.parquet(at)
    training, whole = rows.filter("train"), ["key", *features, "label"]
    parts = max(16, -(-training.count() // bucket))
    training = training.repartition(parts, F.xxhash64(*whole, F.lit(seed))).sortWithinPartitions(*whole)
    assemble = VectorAssembler(inputCols=features, outputCol="features")
    model = RandomForestRegressor(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(assemble.transform(training))
    held = rows.filter(~F.col("train"))
    total = held.agg(F.count("*").alias("n"), F.avg("label").alias("mean"), F.var_pop("label").alias("var")).first()
    place = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(max(1, -(-total["n"] // bucket))))
    order = lambda k: [F.xxhash64("key", *features, "label", k), "key", *features, "label"]
    own = held.withColumn("place", place).withColumn("n", F.row_number().over(Window.partitionBy("place").orderBy(*order(F.lit(-1)))))
    own = own.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(-1, len(features))])))
    given = held.withColumn("place", place).withColumn("v", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f).alias("x")) for k, f in enumerate(features)])))
    given = given.withColumn("n", F.row_number().over(Window.partitionBy("place", "v.k").orderBy(*order(F.col("v.k"))))).select("place", F.col("v.k").alias("k"), "n", F.col("v.x").alias("x"))
    mixed = own.join(given, ["place", "k", "n"], "left")
    mixed = mixed.withColumns({f: F.when(F.col("k") == k, F.col("x")).otherwise(F.col(f)) for k, f in enumerate(features)})
    error = F.avg(F.pow(F.col("label") - F.col("prediction"), 2))
    r2 = {r["k"]: 1 - r["e"] / total["var"] for r in model.transform(assemble.transform(mixed)).groupBy("k").agg(error.alias("e")).collect()} if total["var"] else {}
    out = [(f, r2.get(-1), r2[-1] - r2[k] if r2 else None) for k, f in enumerate(features)]
    return spark.createDataFrame(out, "feature string, r2 double, importance double")
