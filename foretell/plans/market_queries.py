"""Queries on prices, scores, bins and statistics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretell.functions.numbers import half_up
from foretell.operators import asof, binning, pricing, ranks, scoring, stats
from foretell.plans.registry import registry
from foretell.plans.views import DAY, PRELUDE, markets, ticks
from foretell.sources.shared import written

query, QUERIES, SQL = registry(PRELUDE)


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    m = markets(spark, sf).filter(F.col("outcome").isNotNull()).select("market_id", "platform", "category", "volume_usd", "outcome", "close_ts")
    return asof.horizons(m, ticks(spark, sf), [1, 7, 30]).drop("close_ts")


def day_one(spark: SparkSession, sf: str) -> DataFrame:
    return predictions(spark, sf).filter("days = 1")


def t_tail(t: str, freedom: str) -> str:
    """SQL for the two-sided p of a t statistic: one less the density's integral by Simpson's rule."""
    return f"""(SELECT 1 - 2 * max(t) / 4000 / 3 * sum(w * exp(lgamma((n + 1) / 2) - lgamma(n / 2)) / sqrt(n * pi()) * pow(1 + x * x / n, -(n + 1) / 2)) FROM (SELECT t, n, t * i / 4000 AS x, CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM (SELECT abs({t}) AS t, CAST({freedom} AS DOUBLE) AS n), range(4001) r(i)))"""


LAST = "(array_agg(price ORDER BY ts DESC, ord DESC, price DESC))[1]"


@query(", a AS (SELECT category, days, count(*) AS n, floor(avg((p - outcome) * (p - outcome)) * 1000000 + 0.500001) / 1000000 AS brier FROM predictions GROUP BY ALL) SELECT * FROM a")
def brier_by_category_and_horizon(spark, sf):
    p = predictions(spark, sf)
    return p.groupBy("category", "days").agg(F.count("*").alias("n"), half_up(F.avg(scoring.brier(F.col("p"), F.col("outcome"))), 6).alias("brier"))


_ASOF = f"SELECT m.market_id, m.close_ts, p.price FROM markets m LEFT JOIN (SELECT k.market_id, {LAST} AS price FROM markets k JOIN ticks t ON t.market_id = k.market_id AND t.ts <= k.close_ts GROUP BY 1) p USING (market_id)"


@query(_ASOF)
def asof_backward(spark, sf):
    return asof.backward(markets(spark, sf).select("market_id", "close_ts"), ticks(spark, sf), "market_id", "close_ts", "ts", "price", ["ord", "price"])


@query(_ASOF)
def asof_backward_merge(spark, sf):
    return asof.backward(markets(spark, sf).select("market_id", "close_ts"), ticks(spark, sf), "market_id", "close_ts", "ts", "price", ["ord", "price"], strategy="merge")


@query(_ASOF)
def asof_scan(spark, sf):
    return asof.backward(markets(spark, sf).select("market_id", "close_ts"), ticks(spark, sf), "market_id", "close_ts", "ts", "price", ["ord", "price"], strategy="scan")


@query(f"SELECT m.market_id, m.close_ts, p.price FROM markets m LEFT JOIN (SELECT k.market_id, coalesce((array_agg(price ORDER BY ts DESC, ord DESC, price DESC) FILTER (WHERE t.ts <= k.close_ts - 2592000))[1], (array_agg(price ORDER BY ts, ord, price))[1]) AS price FROM markets k JOIN ticks t ON t.market_id = k.market_id GROUP BY 1) p USING (market_id)")
def asof_or_first(spark, sf):
    m = markets(spark, sf).select("market_id", "close_ts").withColumn("at", F.col("close_ts") - 30 * DAY)
    return asof.backward_or_first(m, ticks(spark, sf), "market_id", "at", "ts", "price", ["ord", "price"]).drop("at")


@query("SELECT k.market_id, k.close_ts, (array_agg(price ORDER BY abs(t.ts - k.close_ts), t.ts, ord, price))[1] AS price FROM markets k JOIN ticks t ON t.market_id = k.market_id GROUP BY 1, 2")
def asof_nearest(spark, sf):
    return asof.nearest(markets(spark, sf).select("market_id", "close_ts"), ticks(spark, sf), "market_id", "close_ts", "ts", "price", ["ord", "price"]).filter(F.col("price").isNotNull())


@query(f"SELECT m.market_id, p.price FROM markets m LEFT JOIN (SELECT k.market_id, {LAST} AS price FROM markets k JOIN ticks t ON t.market_id = k.market_id AND t.ts BETWEEN k.close_ts - 2592000 AND k.close_ts GROUP BY 1) p USING (market_id)")
def resolution_price(spark, sf):
    m = markets(spark, sf).select("market_id", "close_ts").withColumn("from_ts", F.col("close_ts") - 30 * DAY)
    return asof.backward(m, ticks(spark, sf), "market_id", "close_ts", "ts", "price", ["ord", "price"], lower="from_ts").select("market_id", "price")


@query(f"SELECT m.market_id, p.price FROM markets m LEFT JOIN (SELECT k.market_id, {LAST} AS price FROM markets k JOIN ticks t ON t.market_id = k.market_id AND t.ts <= (k.close_ts - 864000) // 86400 * 86400 GROUP BY 1) p USING (market_id)")
def eve_price(spark, sf):
    m = markets(spark, sf).select("market_id", (F.floor((F.col("close_ts") - 10 * DAY) / DAY) * DAY).alias("at"))
    return asof.backward(m, ticks(spark, sf), "market_id", "at", "ts", "price", ["ord", "price"]).drop("at")


_SNAP = ", snaps AS (SELECT market_id, ts, ord, CASE WHEN flag = 'A' THEN NULL WHEN flag = 'N' THEN price + 0.5 ELSE price END AS midpoint, CASE WHEN flag = 'A' THEN price END AS best_bid, price + tax AS best_ask FROM ticks)"


@query(_SNAP + ", s AS (SELECT k.market_id, k.close_ts, (array_agg(struct_pack(m := midpoint, b := best_bid, a := best_ask) ORDER BY s.ts DESC, ord DESC))[1] AS x FROM markets k JOIN snaps s ON s.market_id = k.market_id AND s.ts <= k.close_ts GROUP BY 1, 2) SELECT market_id, round(CASE WHEN x.m BETWEEN 0 AND 1 THEN x.m WHEN x.b > 0 AND x.a <= 1 THEN (x.b + x.a) / 2 END, 6) AS midpoint FROM s")
def snapshot_midpoint(spark, sf):
    t = ticks(spark, sf)
    snaps = t.select("market_id", "ts", "ord", F.when(F.col("flag") == "N", F.col("price") + 0.5).when(F.col("flag") == "R", F.col("price")).alias("midpoint"), F.when(F.col("flag") == "A", F.col("price")).alias("best_bid"), (F.col("price") + F.col("tax")).alias("best_ask"))
    m = markets(spark, sf).select("market_id", "close_ts").join(t.select("market_id", "ts"), "market_id").filter("ts <= close_ts").select("market_id", "close_ts").distinct()
    return rounded(asof.snapshot_midpoint(m, snaps, "market_id", "close_ts", "ts", ["ord"]), "midpoint").select("market_id", "midpoint")


_WINDOWS = {"mean_7d": 7 * DAY, "mean_30d": 30 * DAY, "mean_90d": 90 * DAY}


@query(", w AS (SELECT k.market_id, " + ", ".join(f"avg(price) FILTER (WHERE t.ts >= k.close_ts - {w}) AS {n}" for n, w in _WINDOWS.items()) + f", {LAST} AS last FROM markets k JOIN ticks t ON t.market_id = k.market_id AND t.ts <= k.close_ts GROUP BY 1) SELECT m.market_id, " + ", ".join(f"round(coalesce({n}, last), 6) AS {n}" for n in _WINDOWS) + " FROM markets m LEFT JOIN w USING (market_id)")
def window_means(spark, sf):
    out = pricing.window_means(markets(spark, sf).select("market_id", "close_ts"), ticks(spark, sf), "close_ts", _WINDOWS)
    return rounded(out, *_WINDOWS).drop("close_ts")


@query("SELECT market_id, floor(sum(price * size) / sum(size) * 10000 + 0.500001) / 10000 AS vwap, count(*) AS trade_count, CAST(round(sum(size)) AS BIGINT) AS total_volume FROM ticks GROUP BY 1")
def trade_vwap(spark, sf):
    return pricing.trade_vwap(ticks(spark, sf), ["market_id"])


def _tier_sql() -> str:
    hours = (6, 12, 24)
    parts = ", ".join(f"count(*) FILTER (WHERE age <= {h * 3600}) AS n{h}, floor(sum(price * size) FILTER (WHERE age <= {h * 3600}) / sum(size) FILTER (WHERE age <= {h * 3600}) * 10000 + 0.500001) / 10000 AS v{h}, CAST(round(sum(size) FILTER (WHERE age <= {h * 3600})) AS BIGINT) AS s{h}" for h in hours)
    return f"""
WITH e AS (SELECT event_type, user_id % 10 AS bucket, (user_id % 100) / 100.0 AS price, round(abs(value), 2) + 1 AS size, max(CAST(floor(epoch(ts)) AS BIGINT)) OVER () - CAST(floor(epoch(ts)) AS BIGINT) AS age FROM events),
w AS (SELECT event_type, bucket, {parts} FROM e WHERE age <= 86400 GROUP BY 1, 2)
SELECT event_type, bucket, CASE WHEN n6 >= 10 THEN v6 WHEN n12 >= 10 THEN v12 ELSE v24 END AS vwap, CASE WHEN n6 >= 10 THEN 6 WHEN n12 >= 10 THEN 12 WHEN n24 >= 10 THEN 24 ELSE 0 END AS window_hours,
       CASE WHEN n6 >= 10 THEN n6 WHEN n12 >= 10 THEN n12 ELSE n24 END AS trade_count, CASE WHEN n6 >= 10 THEN s6 WHEN n12 >= 10 THEN s12 ELSE s24 END AS volume,
       CASE WHEN n6 >= 10 THEN 1 WHEN n12 >= 10 OR n24 >= 10 THEN 2 ELSE 3 END AS tier FROM w"""


def event_trades(spark, sf) -> DataFrame:
    """events as trades: price from the user, size from the value."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    ts = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return e.select("event_type", (F.col("user_id") % 10).alias("bucket"), ((F.col("user_id") % 100) / 100.0).alias("price"), (F.round(F.abs("value"), 2) + 1).alias("size"), ts.alias("ts"))


@query(_tier_sql(), prelude="")
def tiered_vwap(spark, sf):
    t = event_trades(spark, sf)
    now = t.select(F.max("ts").alias("now"))
    return pricing.tiered_vwap(t.crossJoin(F.broadcast(now)), ["event_type", "bucket"], F.col("now") - F.col("ts")).na.fill(0, ["window_hours"])


_VENUE = ", v AS (SELECT m.category, m.platform, floor(sum(price * size) / sum(size) * 10000 + 0.500001) / 10000 AS vwap, CAST(round(sum(size)) AS BIGINT) AS volume FROM markets m JOIN ticks t USING (market_id) GROUP BY 1, 2)"


@query(_VENUE + " SELECT a.category, floor((a.vwap * a.volume + b.vwap * b.volume) / (a.volume + b.volume) * 10000 + 0.500001) / 10000 AS price, a.volume + b.volume AS volume FROM v a JOIN v b ON a.category = b.category AND a.platform = 'polymarket' AND b.platform = 'kalshi'")
def cross_venue_price(spark, sf):
    t = markets(spark, sf).select("market_id", "platform", "category").join(ticks(spark, sf), "market_id")
    v = t.groupBy("category", "platform").agg(pricing.vwap(F.col("price"), F.col("size")).alias("vwap"), F.round(F.sum("size")).cast("long").alias("volume"), F.lit(None).cast("double").alias("midpoint"))
    return pricing.cross_venue(v.filter("platform = 'polymarket'"), v.filter("platform = 'kalshi'"), "category")


@query("SELECT m.category, floor(sum(price * size) / sum(size) * 10000 + 0.500001) / 10000 AS vwap, count(*) AS trade_count, CAST(round(sum(size)) AS BIGINT) AS total_volume FROM markets m JOIN ticks t USING (market_id) GROUP BY 1")
def pooled_vwap(spark, sf):
    return pricing.trade_vwap(markets(spark, sf).select("market_id", "category").join(ticks(spark, sf), "market_id"), ["category"])


@query("SELECT market_id, ord, ts, round(coalesce(CASE WHEN flag = 'N' THEN price * 100 END, CASE WHEN side = 'F' AND flag = 'R' THEN price * 100 - 1 END, (CASE WHEN tax < 0.05 THEN price * 100 END + (price + tax) * 100) / 2, (price + tax) * 100) / 100, 6) AS candle, round(CASE WHEN tax < 0.05 AND price > 0 THEN (price * 100 + (price + tax) * 100) / 200 ELSE price END, 6) AS quote FROM ticks")
def candle_and_quote_price(spark, sf):
    t = ticks(spark, sf)
    cents = F.col("price") * 100
    bid = F.when(F.col("tax") < 0.05, cents)
    ask = (F.col("price") + F.col("tax")) * 100
    close = F.when(F.col("flag") == "N", cents)
    previous = F.when((F.col("side") == "F") & (F.col("flag") == "R"), cents - 1)
    return rounded(t.select("market_id", "ord", "ts", pricing.candle_price(close, previous, bid, ask).alias("candle"), pricing.quote_price(bid, ask, cents).alias("quote")), "candle", "quote")


_S = "count(*) AS n, round(avg((p - outcome) * (p - outcome)), 6) AS brier, round(avg(-(outcome * ln(least(greatest(p, 1e-15), 1 - 1e-15)) + (1 - outcome) * ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)))), 6) AS log_loss, round(avg(abs(p - outcome)), 6) AS mae, round(avg(CASE WHEN p > 0.5 THEN outcome WHEN p < 0.5 THEN 1 - outcome END), 6) AS accuracy"


@query(f"SELECT platform, days, {_S} FROM predictions GROUP BY 1, 2")
def scores_by_platform_and_horizon(spark, sf):
    return rounded(scoring.scores(predictions(spark, sf), ["platform", "days"]), "brier", "log_loss", "mae", "accuracy")


@query(", l AS (SELECT market_id, arg_min(p, days) AS p, any_value(outcome) AS outcome FROM predictions GROUP BY 1) SELECT round(avg(CASE WHEN p > 0.5 THEN outcome WHEN p < 0.5 THEN 1 - outcome END), 6) AS accuracy, count(*) FILTER (WHERE p <> 0.5) AS n FROM l")
def directional_accuracy(spark, sf):
    return rounded(scoring.directional_accuracy(predictions(spark, sf), "market_id", "days"), "accuracy")


@query("SELECT category, count(*) AS n, round(avg(volume_usd), 4) AS mean, round(median(volume_usd), 4) AS median, round(sum(volume_usd), 2) AS total FROM markets GROUP BY 1")
def volume_stats(spark, sf):
    own = markets(spark, sf)
    m = own.groupBy("category").agg(F.count("*").alias("n"), F.avg("volume_usd").alias("mean"), F.round(F.sum("volume_usd"), 2).alias("total"))
    return rounded(m.join(ranks.group_quantiles(own, "volume_usd", {"median": 0.5}, ["category"]), "category"), "mean", "median", places=4)


@query("SELECT category, round(sum((p - outcome) * (p - outcome) * volume_usd) / sum(volume_usd), 6) AS weighted, round(avg((p - outcome) * (p - outcome)), 6) AS plain, count(*) AS n FROM predictions WHERE days = 1 GROUP BY 1")
def volume_weighted_brier(spark, sf):
    return rounded(scoring.volume_weighted(day_one(spark, sf), ["category"], scoring.brier(F.col("p"), F.col("outcome")), F.col("volume_usd")), "weighted", "plain")


@query("SELECT coalesce(category, 'ALL') AS category, count(*) AS n, round(avg((p - outcome) * (p - outcome)), 6) AS brier FROM predictions WHERE days = 1 AND category IS NOT NULL GROUP BY ROLLUP (category)")
def brier_with_total(spark, sf):
    return rounded(scoring.with_total(day_one(spark, sf), "category", [F.count("*").alias("n"), F.avg(scoring.brier(F.col("p"), F.col("outcome"))).alias("brier")]), "brier")


@query(", c AS (SELECT a.*, b.days AS cohort FROM predictions a JOIN (SELECT DISTINCT market_id, days FROM predictions) b ON a.market_id = b.market_id AND a.days <= b.days) SELECT cohort, days, category, platform, floor(avg((p - outcome) * (p - outcome)) * 1000000 + 0.500001) / 1000000 AS brier, count(DISTINCT market_id) AS n FROM c GROUP BY GROUPING SETS ((cohort, days), (cohort, days, category), (cohort, days, category, platform))")
def cohort_curves(spark, sf):
    return scoring.cohorts(predictions(spark, sf), "market_id", "days", ["category", "platform"]).withColumn("brier", half_up(F.col("brier"), 6))


@query("SELECT category, count(*) FILTER (WHERE platform = 'kalshi') AS kalshi, count(*) FILTER (WHERE platform = 'polymarket') AS polymarket FROM markets GROUP BY 1")
def count_pivot(spark, sf):
    return scoring.pivot_counts(markets(spark, sf), "category", "platform", ["kalshi", "polymarket"])


_MONTHS = [f"{m:02d}" for m in range(1, 13)]


@query("SELECT category, CAST(year(to_timestamp(close_ts) AT TIME ZONE 'UTC') AS INTEGER) AS year, " + ", ".join(f"""round(coalesce(sum(volume_usd) FILTER (WHERE strftime(to_timestamp(close_ts) AT TIME ZONE 'UTC', '%m') = '{m}'), 0), 2) AS "{m}\"""" for m in _MONTHS) + " FROM markets GROUP BY 1, 2")
def monthly_volume(spark, sf):
    """Every month of every year: a row per category and year."""
    closed = F.expr("timestampadd(SECOND, close_ts, TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    m = markets(spark, sf).withColumn("year", F.year(closed))
    return rounded(scoring.monthly_pivot(m, ["category", "year"], F.date_format(closed, "MM"), _MONTHS, "volume_usd"), *_MONTHS, places=2)


@query("SELECT count(DISTINCT category) AS categories, count(DISTINCT wallet) AS wallets, count(DISTINCT platform || category) AS pairs, (SELECT count(*) FROM ticks) AS observations FROM markets")
def distinct_counts(spark, sf):
    m = markets(spark, sf).agg(F.countDistinct("category").alias("categories"), F.countDistinct("wallet").alias("wallets"), F.countDistinct(F.concat("platform", "category")).alias("pairs"))
    return m.crossJoin(F.broadcast(ticks(spark, sf).agg(F.count("*").alias("observations"))))


@query(", a AS (SELECT platform, count(*) AS n, median(volume_usd) AS median_volume, avg(outcome) AS yes_rate, count(DISTINCT category) AS categories FROM markets GROUP BY 1) SELECT platform, metric, round(value, 4) AS value FROM (SELECT platform, 'n' AS metric, CAST(n AS DOUBLE) AS value FROM a UNION ALL SELECT platform, 'median_volume', median_volume FROM a UNION ALL SELECT platform, 'yes_rate', yes_rate FROM a UNION ALL SELECT platform, 'categories', categories FROM a)")
def platform_table(spark, sf):
    return rounded(scoring.attribute_table(markets(spark, sf), "platform", {"n": F.count("*"), "yes_rate": F.avg("outcome"), "categories": F.countDistinct("category")}, {"median_volume": "volume_usd"}), "value", places=4)


_PANEL = ", w AS (SELECT wallet, days, p, outcome, (p - outcome) * (p - outcome) AS brier, market_id FROM predictions JOIN (SELECT market_id, wallet FROM markets) USING (market_id)), a AS (SELECT market_id AS k, brier, p, outcome FROM w WHERE days = 1), b AS (SELECT market_id AS k, brier, p FROM w WHERE days = 30)"


def _panels(spark, sf):
    p = predictions(spark, sf).withColumn("brier", scoring.brier(F.col("p"), F.col("outcome"))).withColumnRenamed("market_id", "k")
    return p.filter("days = 1"), p.filter("days = 30")


@query(_PANEL + ", d AS (SELECT a.brier AS x, b.brier AS y, a.brier - b.brier AS d FROM a JOIN b USING (k)) SELECT count(*) AS n, count(*) FILTER (WHERE d < 0) AS a_wins, count(*) FILTER (WHERE d > 0) AS b_wins, count(*) FILTER (WHERE d = 0) AS ties, round(avg(d), 6) AS mean_diff, round(corr(x, y), 6) AS r, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 4) AS t, round(" + t_tail("(SELECT avg(d) / (stddev_samp(d) / sqrt(count(*))) FROM d)", "(SELECT count(*) - 1 FROM d)") + ", 5) AS p_value FROM d")
def head_to_head(spark, sf):
    return rounded(rounded(rounded(scoring.head_to_head(*_panels(spark, sf), "k"), "mean_diff", "r"), "t", places=4), "p_value", places=5)


@query(_PANEL + " SELECT count(*) AS n, round(avg(a.brier), 6) AS a, round(avg(b.brier), 6) AS b, round(avg(((a.p + b.p) / 2 - outcome) * ((a.p + b.p) / 2 - outcome)), 6) AS both FROM a JOIN b USING (k)")
def consensus(spark, sf):
    return rounded(scoring.consensus(*_panels(spark, sf), "k"), "a", "b", "both")


@query("WITH j AS (SELECT quality = 1 AS pred, toxic = 0 AS act FROM labels), c AS (SELECT count(*) FILTER (WHERE pred AND act) AS tp, count(*) FILTER (WHERE pred AND NOT act) AS fp, count(*) FILTER (WHERE NOT pred AND act) AS fn, count(*) FILTER (WHERE NOT pred AND NOT act) AS tn FROM j) SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM c", prelude="")
def classification_metrics(spark, sf):
    return rounded(scoring.classification(spark.read.parquet(f"{sf}/labels.parquet"), F.col("quality") == 1, F.col("toxic") == 0), "accuracy", "precision", "recall", "f1")


@query(", v AS (SELECT wallet, sum(volume_usd) AS v FROM markets GROUP BY 1), r AS (SELECT v, row_number() OVER (ORDER BY v DESC, wallet) AS rank, count(*) OVER () AS n, sum(v) OVER () AS t FROM v) SELECT max(n) AS n, round(sum(v) FILTER (WHERE rank <= greatest(1, floor(n * 0.01))) / max(t), 6) AS top_1, round(sum(v) FILTER (WHERE rank <= greatest(1, floor(n * 0.1))) / max(t), 6) AS top_10 FROM r")
def volume_concentration(spark, sf):
    return rounded(scoring.concentration(markets(spark, sf), "wallet", "volume_usd", {"top_1": 0.01, "top_10": 0.1}), "top_1", "top_10")


_RANKED = ", d AS (SELECT market_id, p, outcome, volume_usd, category FROM predictions WHERE days = 1), r AS (SELECT *, row_number() OVER (ORDER BY p, market_id % 16, market_id) AS rank, count(*) OVER () AS n FROM d)"


@query(_RANKED + ", b AS (SELECT *, CAST(least((rank - 1) // (n // 40), 39) AS INTEGER) AS bin FROM r) SELECT bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(outcome), 6) AS mean_outcome FROM b GROUP BY 1")
def equal_count_calibration(spark, sf):
    return rounded(binning.calibration(binning.equal_count_bins(day_one(spark, sf), "p", "market_id", 40), "bin", "p", "outcome"), "mean_p", "mean_outcome")


@query(", q AS (SELECT list_distinct(quantile_cont(volume_usd, [i / 10.0 FOR i IN range(11)])) AS e FROM markets), b AS (SELECT greatest(len(list_filter(e, lambda x: x < volume_usd)) - 1, 0) AS bin, volume_usd FROM markets, q) SELECT bin, count(*) AS n, round(min(volume_usd), 4) AS low, round(max(volume_usd), 4) AS high FROM b GROUP BY 1".replace("quantile_cont(volume_usd, [i / 10.0 FOR i IN range(11)])", "quantile_cont(volume_usd, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])"))
def quantile_bins(spark, sf):
    b = binning.quantile_bins(markets(spark, sf), "volume_usd", 10).groupBy("bin").agg(F.count("*").alias("n"), F.min("volume_usd").alias("low"), F.max("volume_usd").alias("high"))
    return rounded(b, "low", "high", places=4)


@query(", e AS (SELECT min(volume_usd) AS lo, max(volume_usd) AS hi FROM markets), b AS (SELECT greatest(len(list_filter(range(21), lambda i: CASE WHEN i = 20 THEN hi ELSE lo + i * ((hi - lo) / 20) END < volume_usd)) - 1, 0) AS bin FROM markets, e) SELECT bin, count(*) AS n FROM b GROUP BY 1")
def equal_width_bins(spark, sf):
    return binning.equal_width_bins(markets(spark, sf), "volume_usd", 20).groupBy("bin").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN volume_usd > 50000 AND volume_usd <= 100000 THEN 0 WHEN volume_usd > 100000 AND volume_usd <= 200000 THEN 1 WHEN volume_usd > 200000 AND volume_usd <= 400000 THEN 2 ELSE -1 END AS bin, count(*) AS n FROM markets GROUP BY 1")
def explicit_bins(spark, sf):
    return markets(spark, sf).groupBy(F.coalesce(binning.cut(F.col("volume_usd"), [50000.0, 100000.0, 200000.0, 400000.0]), F.lit(-1)).alias("bin")).agg(F.count("*").alias("n"))


@query(", x AS (SELECT market_id, p, (rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0) / count(*) OVER () AS pct, (rank() OVER (PARTITION BY category ORDER BY p) + (count(*) OVER (PARTITION BY category, p) - 1) / 2.0) / count(*) OVER (PARTITION BY category) AS in_category FROM predictions WHERE days = 1) SELECT market_id, p, round(pct, 6) AS pct, round(in_category, 6) AS in_category FROM x")
def percentile_ranks(spark, sf):
    d = day_one(spark, sf).select("market_id", "category", "p")
    return rounded(ranks.rank_pct(ranks.rank_pct(written(d), "p", "pct"), "p", "in_category", by="category"), "pct", "in_category").drop("category")


@query(_RANKED + " SELECT market_id, p, round(rank / n, 6) AS cdf FROM r")
def ecdf(spark, sf):
    return rounded(binning.ecdf(day_one(spark, sf).select("market_id", "p"), "p", "market_id"), "cdf")


@query(", h AS (SELECT least(len(list_filter(range(51), lambda i: CASE WHEN i = 50 THEN 1.0 ELSE 0.0 + i * ((1.0 - 0.0) / 50) END <= price)) - 1, 49) AS bin, count(*) AS n FROM ticks GROUP BY 1) SELECT s.bin, coalesce(n, 0) AS n FROM range(50) s(bin) LEFT JOIN h USING (bin)".replace("0.0 + i * ((1.0 - 0.0) / 50)", "CAST(0 AS DOUBLE) + i * (CAST(1 AS DOUBLE) / 50)"))
def price_histogram(spark, sf):
    return binning.histogram(ticks(spark, sf), "price", 50, 0.0, 1.0)


@query(", s AS (SELECT market_id, volume_usd, category, (volume_usd - avg(volume_usd) OVER ()) / stddev_samp(volume_usd) OVER () AS z, (volume_usd - avg(volume_usd) OVER (PARTITION BY category)) / (stddev_samp(volume_usd) OVER (PARTITION BY category) + 1e-10) AS zc FROM markets) SELECT market_id, round(z, 5) AS z, round(zc, 5) AS zc FROM s")
def z_scores(spark, sf):
    m = markets(spark, sf).select("market_id", "category", "volume_usd")
    return rounded(binning.z_score(binning.z_score(m, "volume_usd"), "volume_usd", "category", "zc"), "z", "zc", places=5).select("market_id", "z", "zc")


@query(", w AS (SELECT market_id, ord, ts, price, min(ts) OVER (PARTITION BY market_id) AS a, max(ts) OVER (PARTITION BY market_id) AS b FROM ticks) SELECT market_id, ord, price, floor((ts - a) / CASE WHEN b = a THEN 1 ELSE b - a END * 1000000 + 0.500001) / 1000000 AS life FROM w")
def life_fraction(spark, sf):
    return binning.life_fraction(ticks(spark, sf).select("market_id", "ord", "ts", "price"), "market_id", "ts").withColumn("life", half_up(F.col("life"), 6)).drop("ts")


@query("SELECT market_id, count(*) AS n, CASE WHEN count(*) >= 2 THEN (max(ts) - min(ts)) / 86400 ELSE 0 END AS days FROM ticks GROUP BY 1")
def durations(spark, sf):
    return binning.duration_days(ticks(spark, sf), "market_id", "ts")


@query(", e AS (SELECT min(volume_usd) AS lo, max(volume_usd) AS hi FROM predictions WHERE days = 1), b AS (SELECT market_id, (p - outcome) * (p - outcome) - p * (1 - p) AS rb, greatest(len(list_filter(range(11), lambda i: CASE WHEN i = 10 THEN hi ELSE lo + i * ((hi - lo) / 10) END < volume_usd)) - 1, 0) AS bin FROM predictions, e WHERE days = 1) SELECT market_id, round(rb - avg(rb) OVER (PARTITION BY bin), 6) AS residual FROM b")
def residual_by_volume_bin(spark, sf):
    d = day_one(spark, sf).withColumn("rb", stats.residual_brier(F.col("p"), F.col("outcome")))
    return rounded(binning.residual(binning.equal_width_bins(d, "volume_usd", 10), "rb", "bin"), "residual").select("market_id", "residual")


@query(", d AS (SELECT p * 100 AS v FROM predictions WHERE days = 1), m AS (SELECT stddev_samp(v) * pow(count(*), -0.2) AS h FROM d), g AS (SELECT 0.0 + i * (100.0 / 49) AS x FROM range(50) t(i)) SELECT round(x, 6) AS x, round(avg(exp(-((x - v) / h) * ((x - v) / h) / 2)) / (max(h) * sqrt(2 * pi())), 8) AS density FROM d, m, g GROUP BY 1")
def price_density(spark, sf):
    out = stats.kde(day_one(spark, sf).withColumn("v", F.col("p") * 100), "v", 50)
    return rounded(rounded(out, "x"), "density", places=8)


@query(", r AS (SELECT p, volume_usd, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS a, rank() OVER (ORDER BY volume_usd) + (count(*) OVER (PARTITION BY volume_usd) - 1) / 2.0 AS b FROM predictions WHERE days = 1) SELECT round(corr(a, b), 6) AS rho, count(*) AS n, round(corr(a, b) * sqrt((count(*) - 2) / (1 - corr(a, b) * corr(a, b))), 4) AS t, round(" + t_tail("(SELECT corr(a, b) * sqrt((count(*) - 2) / (1 - corr(a, b) * corr(a, b))) FROM r)", "(SELECT count(*) - 2 FROM r)") + ", 5) AS p_value FROM r")
def spearman(spark, sf):
    return rounded(rounded(rounded(stats.spearman(day_one(spark, sf), "p", "volume_usd"), "rho"), "t", places=4), "p_value", places=5)


@query("SELECT round(corr(p, volume_usd), 6) AS p_volume_usd, round(corr(p, outcome), 6) AS p_outcome FROM predictions WHERE days = 1")
def correlations(spark, sf):
    return rounded(stats.correlations(day_one(spark, sf), [("p", "volume_usd"), ("p", "outcome")]), "p_volume_usd", "p_outcome")


@query()
def bootstrap_brier(spark, sf):
    return stats.bootstrap_mean(day_one(spark, sf).withColumn("b", scoring.brier(F.col("p"), F.col("outcome"))), "b", 1000)


@query(", d AS (SELECT CAST(outcome AS DOUBLE) AS y, p AS x FROM predictions WHERE days = 1) SELECT 'intercept' AS term, round(regr_intercept(y, x), 6) AS coef, round(regr_r2(y, x), 6) AS r2, count(*) AS n FROM d UNION ALL SELECT 'p', round(regr_slope(y, x), 6), round(regr_r2(y, x), 6), count(*) FROM d")
def least_squares(spark, sf):
    return rounded(stats.ols(day_one(spark, sf), "outcome", ["p"]), "coef", "r2").select("term", "coef", "r2", "n")


@query()
def clustered_least_squares(spark, sf):
    d = stats.dummies(predictions(spark, sf), "platform", ["polymarket", "kalshi"]).withColumn("p_kalshi", F.col("p") * F.col("platform_kalshi"))
    return stats.ols(d, "outcome", ["p", "platform_kalshi", "p_kalshi"], cluster="market_id")


@query("SELECT round(regr_slope(outcome, p), 6) AS slope, round(regr_intercept(outcome, p), 6) AS intercept, round(regr_slope(CASE WHEN p > 0 THEN ln(volume_usd) END, CASE WHEN p > 0 THEN ln(p) END), 6) AS power, round(regr_intercept(CASE WHEN p > 0 THEN ln(volume_usd) END, CASE WHEN p > 0 THEN ln(p) END), 6) AS log_scale FROM predictions WHERE days = 1".replace("regr_slope(outcome, p)", "regr_slope(volume_usd, p)").replace("regr_intercept(outcome, p)", "regr_intercept(volume_usd, p)"))
def fit_lines(spark, sf):
    return rounded(stats.fit_lines(day_one(spark, sf), "p", "volume_usd"), "slope", "intercept", "power", "log_scale")


@query(", g AS (SELECT i / 19.0 AS a, j / 19.0 AS b FROM range(20) t(i), range(20) u(j) WHERE i + j > 0), c AS (SELECT a, b, round(corr(a / (a + b) * p + b / (a + b) * (volume_usd / 1e6), (p - outcome) * (p - outcome)), 12) AS c FROM predictions, g WHERE days = 1 GROUP BY 1, 2) SELECT round(a / (a + b), 6) AS weight_a, round(b / (a + b), 6) AS weight_b, round(c, 6) AS corr FROM c ORDER BY c.c, c.a, c.b LIMIT 1")
def weight_search(spark, sf):
    d = day_one(spark, sf).withColumn("v", F.col("volume_usd") / 1e6).withColumn("b", scoring.brier(F.col("p"), F.col("outcome")))
    return rounded(stats.weight_search(d, "p", "v", "b"), "weight_a", "weight_b", "corr")


@query(", d AS (SELECT *, (p - outcome) * (p - outcome) AS b FROM predictions WHERE days = 1), q AS (SELECT category, quantile_cont(volume_usd, 0.25) AS cut, count(*) AS n FROM d GROUP BY 1), s AS (SELECT d.category, cut, n, count(*) FILTER (WHERE volume_usd <= cut) AS n_low, count(*) FILTER (WHERE volume_usd > cut) AS n_high, avg(b) FILTER (WHERE volume_usd <= cut) AS ml, avg(b) FILTER (WHERE volume_usd > cut) AS mh FROM d JOIN q USING (category) GROUP BY ALL) SELECT category, round(cut, 4) AS cut, n, n_low, n_high, round(ml, 6) AS mean_low, round(mh, 6) AS mean_high, round(mh - ml, 6) AS lift FROM s WHERE n >= 10 AND n_low >= 5 AND n_high >= 5")
def liquidity_split_lift(spark, sf):
    d = day_one(spark, sf).withColumn("b", scoring.brier(F.col("p"), F.col("outcome")))
    return rounded(rounded(stats.split_lift(d, "category", "volume_usd", "b"), "cut", places=4), "mean_low", "mean_high", "lift")


#: Price types of the specification grid: the spot price, means over windows of hours, and the midpoint of the latest quote.
_PRICES = {"spot": None, "vwap_1h": 1, "vwap_3h": 3, "vwap_6h": 6, "vwap_24h": 24, "midpoint": None}
_CUTS = {"resolution": 0, "aggressive": 1, "moderate": 7, "conservative": 14}


def _spec_sql() -> str:
    parts = []
    for price in _PRICES:
        for metric, expr in (("brier", "(v - outcome) * (v - outcome)"), ("logloss", "-(outcome * ln(least(greatest(v, 1e-15), 1 - 1e-15)) + (1 - outcome) * ln(1 - least(greatest(v, 1e-15), 1 - 1e-15)))")):
            parts.append(f"SELECT truncation, '{price}' AS price_type, threshold, '{metric}' AS metric, avg({expr}) FILTER (WHERE platform = 'polymarket') AS a, count(*) FILTER (WHERE platform = 'polymarket') AS na, avg({expr}) FILTER (WHERE platform = 'kalshi') AS b, count(*) FILTER (WHERE platform = 'kalshi') AS nb FROM (SELECT *, {price} AS v FROM x) WHERE v IS NOT NULL AND volume_usd >= threshold GROUP BY 1, 3")
    means = ", ".join(f"avg(price) FILTER (WHERE t.ts >= k.close_ts - h.days * 86400 - {h * 3600}) AS m{h}" for h in _PRICES.values() if h)
    mean = ", ".join(f"coalesce(m{h}, spot) AS {name}" for name, h in _PRICES.items() if h)
    cuts = ", ".join(f"('{k}', {d})" for k, d in _CUTS.items())
    quote = LAST.replace("(array_agg(price ", "(array_agg((price + least(price + tax, 1.0)) / 2 ")
    return f""", w AS (SELECT k.market_id, h.truncation, {LAST} AS spot, {means}, {quote} AS midpoint
  FROM markets k CROSS JOIN (VALUES {cuts}) h(truncation, days) JOIN ticks t ON t.market_id = k.market_id AND t.ts <= k.close_ts - h.days * 86400 GROUP BY 1, 2),
x AS (SELECT w.truncation, m.platform, m.volume_usd, m.outcome, spot, {mean}, midpoint, threshold FROM w JOIN markets m USING (market_id) CROSS JOIN (VALUES (0.0), (1000.0), (10000.0), (100000.0)) q(threshold) WHERE outcome IS NOT NULL),
s AS ({" UNION ALL ".join(parts)})
SELECT truncation, price_type, CAST(threshold AS DOUBLE) AS threshold, metric, round(a, 6) AS pm_score, na AS pm_n, round(b, 6) AS k_score, nb AS k_n, a < b AS pm_wins, round(a - b, 6) AS score_diff, CAST(row_number() OVER (ORDER BY truncation, price_type, threshold, metric) AS INTEGER) AS spec_id FROM s"""


@query(_spec_sql())
def specification_curve(spark, sf):
    """4 truncations x 6 price types x 4 thresholds x 2 metrics: 192 cells.  A quote's bid is the price and its ask the price plus the tax."""
    m = markets(spark, sf).filter(F.col("outcome").isNotNull())
    cuts = F.explode(F.create_map(*[x for k, d in _CUTS.items() for x in (F.lit(k), F.lit(d))])).alias("truncation", "_d")
    asked = m.select("market_id", "platform", "volume_usd", "outcome", "close_ts", cuts).withColumn("at", F.col("close_ts") - F.col("_d") * DAY).drop("_d", "close_ts")
    quotes = ticks(spark, sf).select("market_id", "ts", "ord", "price", F.lit(None).cast("double").alias("midpoint"), F.col("price").alias("best_bid"), F.least(F.col("price") + F.col("tax"), F.lit(1.0)).alias("best_ask"))
    # a quote without a bid has no midpoint by the rules of snapshots; here its mean stands
    prices = pricing.window_means(asked, quotes, "at", {"spot": -1} | {k: h * 3600 for k, h in _PRICES.items() if h}, lasts={"midpoint": (F.col("best_bid") + F.col("best_ask")) / 2}, strategy="agg")
    out = stats.specification_curve(prices, list(_PRICES), [0, 1e3, 1e4, 1e5])
    return rounded(out, "pm_score", "k_score", "score_diff")


@query()
def forest_importance(spark, sf):
    d = predictions(spark, sf).withColumn("rb", stats.residual_brier(F.col("p"), F.col("outcome"))).withColumn("log_volume", F.log("volume_usd"))
    return stats.forest_importance(d, "market_id", ["p", "log_volume", "days"], "rb")
