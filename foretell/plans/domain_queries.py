"""Queries on books, elections, wallets, places, text, matching, quality and search, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretell.functions import numbers
from foretell.functions import text as tx
from foretell.operators import book, elections, frames, geo, matching, quality, ranks, search, traders
from foretell.plans.market_queries import day_one, predictions, rounded
from foretell.plans.registry import registry
from foretell.plans.views import DAY, PRELUDE, markets, table, ticks

query, QUERIES, SQL = registry(PRELUDE)

#: Question templates by market_id mod 12.
QUESTIONS = [
    "Will Donald Trump win the 2024 presidential election?",
    "Will the Republican win the Senate race in Ohio in 2024?",
    "Will turnout exceed 60% of voters in 2024?",
    "Will Joe Biden be the Democratic nominee in 2024?",
    "Will the Fed cut rates below 4.5 percent in 2025?",
    "Who will announce for Governor of West Virginia in 2026?",
    "José García to win the mayoral runoff in 2025",
    "Will Ursula von der Leyen win by more than 5 points?",
    "Will Congress pass a budget by end of 2025?",
    "Democrats control the House after 2026 - Hakeem Jeffries?",
    "Will PA-10 flip in the Republican primary of 2026?",
    "Will inflation reach 3.5% in 2025?",
]
_LIST = "[" + ", ".join("'" + q.replace("'", "''") + "'" for q in QUESTIONS) + "]"
_QUESTIONS = f", q AS (SELECT *, ({_LIST})[market_id % 12 + 1] AS question FROM markets)"


def questions(spark, sf) -> DataFrame:
    return markets(spark, sf).withColumn("question", F.element_at(F.array(*map(F.lit, QUESTIONS)), (F.col("market_id") % 12 + 1).cast("int")))


def books(spark, sf) -> DataFrame:
    """A book per market: bids from lines with status F below one half, asks from the others above."""
    levels = ticks(spark, sf).withColumn("bid", F.col("side") == "F")
    levels = levels.withColumn("level", F.round(F.when(F.col("bid"), F.col("price") / 2).otherwise(0.5 + F.col("tax")), 3))
    return book.build(levels.withColumn("market_id", F.col("market_id") % 500), ["market_id"], F.col("bid"), "level", "size")


_BOOK = """, x AS (SELECT market_id % 500 AS market_id, side = 'F' AS bid, round(CASE WHEN side = 'F' THEN price / 2 ELSE 0.5 + tax END, 3) AS p, size FROM ticks),
l AS (SELECT market_id, bid, p, sum(size) AS s FROM x WHERE p > 0 GROUP BY 1, 2, 3),
b AS (SELECT market_id, max(p) FILTER (WHERE bid) AS best_bid, min(p) FILTER (WHERE NOT bid) AS best_ask, coalesce(sum(s) FILTER (WHERE bid), 0) AS bid_depth, coalesce(sum(s) FILTER (WHERE NOT bid), 0) AS ask_depth, count(*) FILTER (WHERE bid) AS n_bid, count(*) FILTER (WHERE NOT bid) AS n_ask FROM l GROUP BY 1),
c AS (SELECT l.market_id, CASE WHEN bool_or(NOT bid AND p - (best_ask + 0.05) >= 0) THEN floor(coalesce(sum(p * s) FILTER (WHERE NOT bid AND p - (best_ask + 0.05) < 0), 0) + 0.5) END AS up,
      CASE WHEN bool_or(bid AND (p - (best_bid - 0.05)) * -1 >= 0) THEN floor(coalesce(sum(p * s) FILTER (WHERE bid AND (p - (best_bid - 0.05)) * -1 < 0), 0) + 0.5) END AS down FROM l JOIN b USING (market_id) GROUP BY 1)"""


@query(_BOOK + " SELECT market_id, best_bid, best_ask, round(best_ask - best_bid, 6) AS spread, round((best_ask + best_bid) / 2, 6) AS midpoint, round((best_ask - best_bid) / ((best_ask + best_bid) / 2), 6) AS relative_spread, bid_depth, ask_depth, bid_depth + ask_depth AS total_depth, CAST(n_bid AS INTEGER) AS n_bid_levels, CAST(n_ask AS INTEGER) AS n_ask_levels FROM b")
def book_metrics(spark, sf):
    out = book.metrics(books(spark, sf))
    return rounded(out, "spread", "midpoint", "relative_spread").select("market_id", "best_bid", "best_ask", "spread", "midpoint", "relative_spread", "bid_depth", "ask_depth", "total_depth", "n_bid_levels", "n_ask_levels")


_GRADE = "CASE WHEN cost IS NULL OR cost < 10000 THEN 0 WHEN cost < 100000 THEN 1 ELSE 2 END"


@query(_BOOK + f", g AS (SELECT market_id, least(up, down) AS cost, CAST(market_id % 3 + 1 AS INTEGER) AS tier FROM c) SELECT market_id, coalesce(CAST(cost AS BIGINT), -1) AS cost, tier, (['fragile', 'caution', 'robust'])[CASE tier WHEN 3 THEN 0 WHEN 2 THEN greatest({_GRADE} - 1, 0) ELSE {_GRADE} END + 1] AS grade FROM g")
def cost_to_move_grades(spark, sf):
    g = books(spark, sf).withColumn("cost", book.cost_to_move(F.col("bids"), F.col("asks"))).withColumn("tier", (F.col("market_id") % 3 + 1).cast("int"))
    return g.withColumn("grade", book.grade(F.col("cost"), F.col("tier"))).select("market_id", F.coalesce("cost", F.lit(-1)).alias("cost"), "tier", "grade")


@query(_BOOK + ", a AS (SELECT l.market_id, p, s, (best_bid + best_ask) / 2 AS mid, coalesce(sum(p * s) OVER (PARTITION BY l.market_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l JOIN b USING (market_id) WHERE NOT bid AND best_bid IS NOT NULL), t AS (SELECT *, least(p * s, 500 - before) AS cost FROM a WHERE before < 500) SELECT market_id, floor((max(p) - max(mid)) * 100 * 100 + 0.5) / 100 AS impact_cents, CAST(floor(sum(cost / p) + 0.500001) AS BIGINT) AS shares, CAST(count(*) AS INTEGER) AS levels, round(sum(cost), 4) AS spent FROM t GROUP BY 1")
def price_impact(spark, sf):
    m = book.metrics(books(spark, sf)).filter(F.col("midpoint").isNotNull()).select("market_id", "midpoint", book.price_impact(F.col("asks"), F.col("midpoint"), 500.0).alias("i"))
    return m.select("market_id", numbers.half_up(F.col("i.impact_cents"), 2).alias("impact_cents"), "i.shares", "i.levels", F.round("i.spent", 4).alias("spent"))


@query(_BOOK + ", g AS (SELECT market_id, least(up, down) AS cost FROM c), r AS (SELECT *, CASE WHEN cost IS NULL OR cost < 10000 THEN 'fragile' WHEN cost < 100000 THEN 'caution' ELSE 'robust' END AS grade FROM g) SELECT count(*) AS markets, count(cost) AS assessed, count(*) FILTER (WHERE grade = 'robust') AS robust, count(*) FILTER (WHERE grade = 'caution') AS caution, count(*) FILTER (WHERE grade = 'fragile') AS fragile, median(cost) AS median_cost FROM r")
def robustness_summary(spark, sf):
    g = books(spark, sf).withColumn("cost", book.cost_to_move(F.col("bids"), F.col("asks")))
    return book.robustness(g.withColumn("grade", book.grade(F.col("cost"), F.lit(1))))


_LIQ = ", s AS (SELECT market_id % 200 AS market_id, tax AS spread, tax / (price + 0.01) AS relative_spread, size AS bid_depth, price * 50 AS ask_depth, price AS midpoint FROM ticks)"


@query(_LIQ + " SELECT market_id, count(*) AS n_snapshots, round(avg(spread), 6) AS spread_mean, round(median(spread), 6) AS spread_median, round(stddev_pop(spread), 6) AS spread_std, round(min(spread), 6) AS spread_min, round(max(spread), 6) AS spread_max, round(avg(relative_spread * 100), 5) AS rel_spread_mean, round(avg(bid_depth + ask_depth), 6) AS depth_mean, round(avg(CASE WHEN bid_depth + ask_depth > 0 THEN (bid_depth - ask_depth) / (bid_depth + ask_depth) ELSE 0 END), 6) AS imbalance_mean, round(stddev_pop(midpoint), 6) AS price_std FROM s GROUP BY 1")
def liquidity_by_market(spark, sf):
    t = ticks(spark, sf)
    s = t.select((F.col("market_id") % 200).alias("market_id"), F.col("tax").alias("spread"), (F.col("tax") / (F.col("price") + 0.01)).alias("relative_spread"), F.col("size").alias("bid_depth"), (F.col("price") * 50).alias("ask_depth"), F.col("price").alias("midpoint")).withColumn("total_depth", F.col("bid_depth") + F.col("ask_depth"))
    keep = ["spread_mean", "spread_median", "spread_std", "spread_min", "spread_max", "depth_mean", "imbalance_mean", "price_std"]
    return rounded(rounded(book.liquidity(s, ["market_id"]), *keep), "rel_spread_mean", places=5).select("market_id", "n_snapshots", *keep, "rel_spread_mean")


@query(_LIQ + ", d AS (SELECT m.close_ts // 86400 AS day, s.spread, s.bid_depth + s.ask_depth AS depth FROM s JOIN markets m USING (market_id)) SELECT day, round(median(spread) FILTER (WHERE spread > 0), 6) AS median_spread, round(avg(spread) FILTER (WHERE spread > 0), 6) AS mean_spread, round(median(depth) FILTER (WHERE depth > 0), 6) AS median_depth, round(avg(depth) FILTER (WHERE depth > 0), 6) AS mean_depth FROM d GROUP BY 1 HAVING count(*) FILTER (WHERE spread > 0) > 0 AND count(*) FILTER (WHERE depth > 0) > 0")
def daily_liquidity(spark, sf):
    s = ticks(spark, sf).select((F.col("market_id") % 200).alias("market_id"), F.col("tax").alias("spread"), (F.col("size") + F.col("price") * 50).alias("depth"))
    d = s.join(markets(spark, sf).select("market_id", F.floor(F.col("close_ts") / DAY).alias("day")), "market_id")
    d = d.select("day", *[F.when(F.col(c) > 0, F.col(c)).alias(c) for c in ("spread", "depth")])
    medians = ranks.group_medians(d, ["spread", "depth"], ["day"]).select("day", *[F.col(f"{c}_median").alias(f"median_{c}") for c in ("spread", "depth")])
    out = d.groupBy("day").agg(*[F.avg(c).alias(f"mean_{c}") for c in ("spread", "depth")]).join(medians, "day")
    return rounded(out.dropna(), "median_spread", "mean_spread", "median_depth", "mean_depth")


@query(", s AS (SELECT market_id, list_sort(list(price)) AS x FROM ticks GROUP BY 1) SELECT market_id, x[len(x) // 2 + 1] AS upper_median FROM s")
def upper_median(spark, sf):
    return ticks(spark, sf).groupBy("market_id").agg(book.upper_median("price").alias("upper_median"))


_REF = ", f AS (SELECT m.*, t.first_ts, t.days, CASE WHEN market_id % 2 = 0 THEN (close_ts - 5 * 86400) // 86400 * 86400 END AS election_day, market_id % 4 < 2 AS electoral FROM markets m LEFT JOIN (SELECT market_id, min(ts) AS first_ts, CASE WHEN count(*) >= 2 THEN (max(ts) - min(ts)) / 86400 ELSE 0 END AS days FROM ticks GROUP BY 1) t USING (market_id))"


@query(_REF + ", r AS (SELECT *, coalesce(CASE WHEN electoral THEN election_day + 8 * 3600 END, close_ts - CASE WHEN category = '5-LOW' OR days <= 2 THEN 0 WHEN platform = 'kalshi' THEN 1 ELSE 2 END * 86400) AS ref FROM f) SELECT market_id, ref AS reference, CASE WHEN ref < first_ts THEN close_ts - CASE WHEN platform = 'kalshi' THEN 1 ELSE 2 END * 86400 ELSE ref END AS judged FROM r")
def reference_times(spark, sf):
    t = ticks(spark, sf).groupBy("market_id").agg(F.min("ts").alias("first_ts"), F.when(F.count("*") >= 2, (F.max("ts") - F.min("ts")) / DAY).otherwise(0.0).alias("days"))
    m = markets(spark, sf).join(t, "market_id", "left")
    day = F.when(F.col("market_id") % 2 == 0, F.floor((F.col("close_ts") - 5 * DAY) / DAY) * DAY)
    ref = elections.reference_ts(F.col("close_ts"), day, F.col("market_id") % 4 < 2, F.col("platform"), F.col("days"), F.col("category"), ["5-LOW"])
    return m.withColumn("reference", ref).select("market_id", "reference", elections.with_fallback(F.col("reference"), F.col("first_ts"), F.col("close_ts"), F.col("platform")).alias("judged"))


@query(_REF + ", c AS (SELECT market_id, coalesce(election_day + 86399, close_ts - CASE WHEN platform = 'kalshi' THEN 43200 ELSE 86400 END) AS cut FROM f) SELECT t.market_id, count(*) AS n, max(t.ts) AS last_ts FROM ticks t JOIN c USING (market_id) WHERE t.ts <= cut GROUP BY 1")
def truncated_series(spark, sf):
    m = markets(spark, sf).withColumn("election_day", F.when(F.col("market_id") % 2 == 0, F.floor((F.col("close_ts") - 5 * DAY) / DAY) * DAY))
    return elections.truncate(ticks(spark, sf), m).groupBy("market_id").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


def _rx(patterns: list[str]) -> str:
    return tx.any_of(patterns).replace("'", "''")


@query(_QUESTIONS + f" SELECT question, NOT regexp_matches(question, '{_rx(tx.NOT_WINNER)}') AND regexp_matches(question, '{_rx(tx.WINNER)}') AS is_winner, count(*) AS n FROM q GROUP BY 1, 2")
def winner_questions(spark, sf):
    return questions(spark, sf).groupBy("question", tx.is_winner_question(F.col("question")).alias("is_winner")).agg(F.count("*").alias("n"))


@query(_QUESTIONS + ", e AS (SELECT category || '|' || platform || '||' || (1990 + wallet % 20) || '|' || CASE WHEN market_id % 3 = 0 THEN 'True' ELSE 'False' END AS election_key, market_id, volume_usd FROM q) SELECT election_key, count(*) AS n_markets, (array_agg(market_id ORDER BY volume_usd DESC, market_id))[1] AS market_id, max(volume_usd) AS volume_usd FROM e GROUP BY 1")
def election_winners(spark, sf):
    e = markets(spark, sf).withColumn("election_key", elections.election_key(F.col("category"), F.col("platform"), F.lit(None).cast("string"), 1990 + F.col("wallet") % 20, F.col("market_id") % 3 == 0))
    return elections.largest_per_election(e.select("election_key", "market_id", "volume_usd"), "election_key", "volume_usd", "market_id")


@query(", w AS (SELECT platform, volume_usd, CASE WHEN outcome = 0 THEN 1 - p ELSE p END AS w FROM predictions WHERE days = 1) SELECT platform, count(*) AS n, round(avg((w - 1) * (w - 1)), 6) AS brier, round(avg(CASE WHEN w > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(volume_usd) / 1000, 4) AS mean_volume_k, round(median(volume_usd) / 1000, 4) AS median_volume_k FROM w GROUP BY 1")
def winner_panel(spark, sf):
    d = day_one(spark, sf).withColumn("w", elections.winner_prediction(F.col("p"), F.col("outcome")))
    return rounded(rounded(elections.panel(d, ["platform"]), "brier", "accuracy"), "mean_volume_k", "median_volume_k", places=4)


@query(", m AS (SELECT abs(tax - price) * 100 AS m FROM ticks) SELECT CASE WHEN m < 5 THEN '< 5%' WHEN m < 10 THEN '5-10%' WHEN m < 20 THEN '10-20%' ELSE '> 20%' END AS bucket, count(*) AS n FROM m GROUP BY 1")
def margin_buckets(spark, sf):
    return ticks(spark, sf).groupBy(elections.margin_bucket(F.col("tax"), F.col("price")).alias("bucket")).agg(F.count("*").alias("n"))


@query(", s AS (SELECT category, min(market_id) AS market_id FROM markets GROUP BY 1), b AS (SELECT category, (array_agg(market_id ORDER BY volume_usd DESC, market_id))[1] AS best, max(volume_usd) AS v FROM markets GROUP BY 1) SELECT category, CASE WHEN b.v > m.volume_usd THEN best ELSE s.market_id END AS market_id, b.v > m.volume_usd AS swapped FROM s JOIN b USING (category) JOIN markets m ON m.market_id = s.market_id")
def volume_swap(spark, sf):
    m = markets(spark, sf).select("category", "market_id", "volume_usd")
    first = m.groupBy("category").agg(F.min_by(F.struct("market_id", "volume_usd"), "market_id").alias("x")).select("category", "x.*")
    return elections.swap_for_volume(first, m, "category")


_TRADES = ", t AS (SELECT m.wallet, k.market_id, k.price * k.size AS volume, CASE flag WHEN 'A' THEN 'BUY' WHEN 'N' THEN 'SELL' ELSE 'hold' END AS s, CASE side WHEN 'F' THEN 'Yes' ELSE 'No' END AS l, CASE k.market_id % 3 WHEN 0 THEN 'Republican' WHEN 1 THEN 'Democrat' END AS party, m.outcome FROM ticks k JOIN markets m USING (market_id)), d AS (SELECT *, CASE WHEN s = 'hold' OR party IS NULL THEN NULL ELSE ((s = 'BUY') = (l = 'Yes')) = (party = 'Republican') END AS up FROM t), r AS (SELECT *, up = (outcome = 1) AS ok FROM d WHERE up IS NOT NULL AND volume > 0)"


@query(_TRADES + " SELECT wallet, round(coalesce(sum(volume) FILTER (WHERE up), 0), 4) AS volume_for, round(coalesce(sum(volume) FILTER (WHERE NOT up), 0), 4) AS volume_against, round(coalesce(sum(volume) FILTER (WHERE ok), 0), 4) AS volume_right, round(coalesce(sum(volume) FILTER (WHERE NOT ok), 0), 4) AS volume_wrong, count(*) AS n_trades, count(DISTINCT market_id) AS n_markets, floor(coalesce(sum(volume) FILTER (WHERE up), 0) / sum(volume) * 100 * 100000 + 0.500001) / 100000 AS share_for, floor(coalesce(sum(volume) FILTER (WHERE up <> (NOT coalesce(ok, true))), 0) / sum(volume) * 100 * 100000 + 0.500001) / 100000 AS cf_all, floor(coalesce(sum(volume) FILTER (WHERE up AND coalesce(ok, true)), 0) / sum(volume) * 100 * 100000 + 0.500001) / 100000 AS cf_rep_only, floor(coalesce(sum(volume) FILTER (WHERE up OR NOT coalesce(ok, true)), 0) / sum(volume) * 100 * 100000 + 0.500001) / 100000 AS cf_dem_only FROM r GROUP BY 1")
def wallet_stats(spark, sf):
    k = ticks(spark, sf).join(markets(spark, sf).select("market_id", "wallet", "outcome"), "market_id")
    side = F.when(F.col("flag") == "A", "BUY").when(F.col("flag") == "N", "SELL").otherwise("hold")
    party = F.when(F.col("market_id") % 3 == 0, "Republican").when(F.col("market_id") % 3 == 1, "Democrat")
    t = k.withColumn("for_rep", traders.direction(side, F.when(F.col("side") == "F", "Yes").otherwise("No"), party)).withColumn("volume", F.col("price") * F.col("size")).withColumn("right", F.col("for_rep") == (F.col("outcome") == 1))
    out = traders.wallets(t)
    out = out.withColumns({c: numbers.half_up(F.col(c), 5) for c in ("share_for", "cf_all", "cf_rep_only", "cf_dem_only")})
    return rounded(out, "volume_for", "volume_against", "volume_right", "volume_wrong", places=4)


_PLACES = "WITH p AS (SELECT c_custkey AS id, CAST(c_custkey * 37 % 160 - 80 AS DOUBLE) AS lat, CAST(c_custkey * 91 % 360 - 180 AS DOUBLE) AS lng, c_acctbal AS volume, c_mktsegment = 'BUILDING' AS building FROM customer)"


def _places(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 37 % 160 - 80).cast("double").alias("lat"), (F.col("c_custkey") * 91 % 360 - 180).cast("double").alias("lng"), F.col("c_acctbal").alias("volume"), (F.col("c_mktsegment") == "BUILDING").alias("building"))


_BOXES = " ".join(f"WHEN lat BETWEEN {a} AND {b} AND lng BETWEEN {c} AND {d} THEN '{n}'" for n, a, b, c, d in geo.BOXES)


@query(f" SELECT CASE {_BOXES} WHEN lat >= -10 AND (lng > 40 OR lng < -130) THEN 'asia' ELSE 'unknown' END AS region, count(*) AS n FROM p GROUP BY 1", prelude=_PLACES)
def regions(spark, sf):
    return _places(spark, sf).groupBy(geo.region(F.col("lat"), F.col("lng")).alias("region")).agg(F.count("*").alias("n"))


@query(" SELECT round(lat, 2) AS lat, round(lng, 2) AS lng, (array_agg(id ORDER BY volume DESC, id))[1] AS top, round(sum(volume), 4) AS total_volume, count(*) AS n, bool_or(building) AS building FROM p GROUP BY 1, 2", prelude=_PLACES)
def places(spark, sf):
    return rounded(geo.by_coordinates(_places(spark, sf), "lat", "lng", "volume", "id", ["building"]), "total_volume", places=4)


_SLUG = "trim(regexp_replace(upper(strip_accents({0})), '[^A-Z0-9]+', '_', 'g'), '_')"


@query(_QUESTIONS + f" SELECT question, {_SLUG.format('question')} AS slug, left(trim(regexp_replace(regexp_replace(lower(question), '[^a-z0-9_\\s-]', '', 'g'), '[\\s_-]+', '-', 'g'), '-'), 60) AS site_slug, count(*) AS n FROM q GROUP BY ALL")
def slugs(spark, sf):
    q = questions(spark, sf)
    return q.groupBy("question", tx.slug(F.col("question")).alias("slug"), tx.site_slug(F.col("question")).alias("site_slug")).agg(F.count("*").alias("n"))


@query(", v AS (SELECT DISTINCT volume_usd AS v FROM markets UNION SELECT DISTINCT CAST(floor(volume_usd) AS DOUBLE) FROM markets) SELECT v, CASE WHEN v = floor(v) AND v >= 1000000 THEN CAST(v AS BIGINT) // 1000000 || 'M' WHEN v = floor(v) AND v >= 1000 THEN CAST(v AS BIGINT) // 1000 || 'K' WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE replace(CAST(v AS VARCHAR), '.', 'P') END AS slug FROM v")
def number_slugs(spark, sf):
    m = markets(spark, sf)
    v = m.select(F.col("volume_usd").alias("v")).union(m.select(F.floor("volume_usd").cast("double"))).distinct()
    return v.select("v", tx.number_slug(F.col("v")).alias("slug"))


#: What each template says: the frame, its confidence, the event's id and the race's key.
_FIELDS = "frame_type, candidate, party, office, country, scope, scope_type, year, outcome_type, is_primary, metric, threshold_value, threshold_direction, actor, confidence, event_id, race_key"
_SAID = [
    ("contest", "Donald Trump", None, "PRES", None, None, None, 2024, "WIN", False, None, None, None, None, 0.818, "BWR-ELEC-XX-PRES-TRUMP-WIN-2024", "BWR-ELEC-XX-PRES-WIN-2024"),
    ("contest", None, "GOP", "SEN", "US", "OH", "state", 2024, "WIN", False, None, None, None, None, 1.0, "BWR-ELEC-US-SEN-OH-GOP-WIN-2024", "BWR-ELEC-US-SEN-OH-WIN-2024"),
    ("threshold", None, None, None, None, None, None, 2024, None, False, None, 60.0, "above", None, 0.778, None, None),
    ("contest", "Joe Biden", "DEM", None, None, None, None, 2024, "NOMINATION", False, None, None, None, None, 0.636, None, None),
    ("policy_change", None, None, None, None, None, None, 2025, None, False, "RATE", None, "decrease", "FED", 1.0, "BWR-POLICY-FED-RATE-DECREASE-2025", "BWR-POLICY-FED-RATE-DECREASE-2025"),
    ("declaration", None, None, None, "US", "WV", "state", 2026, None, False, None, None, None, None, 1.0, None, None),
    ("contest", "Jose Garcia", None, "MAYOR", None, None, None, 2025, "WIN", False, None, None, None, None, 0.818, "BWR-ELEC-XX-MAYOR-GARCIA-WIN-2025", "BWR-ELEC-XX-MAYOR-WIN-2025"),
    ("contest", "Ursula von der Leyen", None, None, None, None, None, None, "WIN", False, None, None, None, None, 0.364, None, None),
    ("legislation", None, None, None, None, None, None, 2025, None, False, None, None, None, "CONGRESS", 1.0, "BWR-LEG-CONGRESS-2025", "BWR-LEG-CONGRESS-2025"),
    ("contest", "Hakeem Jeffries", "DEM", "HOUSE", None, None, None, 2026, "CONTROL", False, None, None, None, None, 0.818, "BWR-ELEC-XX-HOUSE-JEFFRIES-CONTROL-2026", "BWR-ELEC-XX-HOUSE-CONTROL-2026"),
    ("binary_outcome", None, None, None, "US", "PA-10", "district", 2026, None, False, None, None, None, None, 0.533, None, None),
    ("threshold", None, None, None, None, None, None, 2025, None, False, "INFLATION", 3.5, "above", None, 1.0, "BWR-THRESH-INFLATION-3P5-ABOVE-2025", "BWR-THRESH-INFLATION-3P5-ABOVE-2025"),
]
_NONE = {"year": -1, "threshold_value": -1.0}


def _said_sql() -> str:
    def cell(name: str, v) -> str:
        v = _NONE.get(name, "-") if v is None else v
        return "'" + v + "'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v).lower()

    return ", ".join(f"({i}, " + ", ".join(map(cell, _FIELDS.split(", "), row)) + ")" for i, row in enumerate(_SAID))


@query(_QUESTIONS + f", s(k, {_FIELDS}) AS (VALUES {_said_sql()}) SELECT market_id, question, {_FIELDS} FROM q JOIN s ON q.market_id % 12 = s.k")
def question_frames(spark, sf):
    f = frames.extract(questions(spark, sf).select("market_id", "question"))
    return f.select("market_id", "question", "frame.*", "confidence", frames.event_id(F.col("frame")).alias("event_id"), frames.race_key(F.col("frame")).alias("race_key")).na.fill("-").na.fill(-1)


@query()
def venue_matches(spark, sf):
    q = questions(spark, sf).select(F.col("market_id").alias("id"), "platform", "category", "question")
    f = frames.extract(q.select("question").distinct()).groupBy("question").agg(F.first("frame").alias("frame"))  # an aggregate, so that fields of the frame are not worked out again wherever they are used
    f = q.join(f, "question")
    return matching.one_to_one(f.filter("platform = 'kalshi'"), f.filter("platform = 'polymarket'"))


@query("SELECT market_id % 500 AS id, (array_agg(market_id ORDER BY volume_usd DESC, market_id))[1] AS market_id, max(volume_usd) AS conf FROM markets GROUP BY 1")
def keep_best(spark, sf):
    f = markets(spark, sf).select((F.col("market_id") % 500).alias("id"), "market_id", F.col("volume_usd").alias("conf"))
    return matching.keep_best(f.filter("market_id % 4 < 2"), f.filter("market_id % 4 >= 2"), "id", "conf")


@query(", b AS (SELECT * FROM markets WHERE volume_usd > 300000) SELECT (SELECT count(*) FROM b) AS n, min(volume_usd) AS least, max(volume_usd) AS most, (SELECT array_to_string(list(market_id ORDER BY market_id), ',') FROM (SELECT market_id FROM b ORDER BY 1 LIMIT 10)) AS sample_ids FROM b")
def out_of_range(spark, sf):
    return quality.out_of_range(markets(spark, sf), "volume_usd", "market_id", 0.0, 300000.0).withColumn("sample_ids", F.array_join("sample_ids", ","))


@query(", f AS (SELECT DISTINCT market_id, round(price, 4) AS price, round(tax, 4) AS tax FROM ticks) SELECT price, tax, count(*) AS n FROM f GROUP BY 1, 2 HAVING count(*) >= 3")
def repeated_pairs(spark, sf):
    return quality.repeated_pairs(ticks(spark, sf), "market_id", "price", "tax")


@query("SELECT round(count(outcome) / count(*), 6) AS outcome, round(count(volume_usd) / count(*), 6) AS volume_usd, round((count(outcome) / count(*) + count(volume_usd) / count(*)) / 2, 6) AS overall FROM markets")
def coverage(spark, sf):
    return rounded(quality.coverage(markets(spark, sf), ["outcome", "volume_usd"]), "outcome", "volume_usd", "overall")


@query("SELECT platform, count(*) AS n, round(count(*) / (SELECT count(*) FROM markets), 6) AS share FROM markets GROUP BY 1 HAVING count(*) / (SELECT count(*) FROM markets) > 0.4")
def category_skew(spark, sf):
    return rounded(quality.skew(markets(spark, sf), "platform", 0.4), "share")


@query("SELECT flag, count(*) AS count FROM ticks WHERE flag NOT IN ('A', 'N') GROUP BY 1")
def outside_domain(spark, sf):
    return quality.outside_domain(ticks(spark, sf), "flag", ["A", "N"])


@query("SELECT market_id, platform, CASE WHEN market_id % 5 <> 0 THEN volume_usd END AS volume_usd, CASE WHEN market_id % 5 = 0 THEN category END AS category FROM markets")
def incremental_merge(spark, sf):
    m = markets(spark, sf)
    master = m.filter("market_id % 5 <> 0").select("market_id", "platform", "volume_usd")
    new = m.filter("market_id % 5 = 0 OR market_id % 7 = 0").select("market_id", "platform", "category")
    return quality.merge(master, new, ["market_id"]).select("market_id", "platform", "volume_usd", "category")


@query("SELECT market_id, price, ts FROM ticks WHERE flag = 'A' UNION ALL SELECT market_id, price, ts FROM ticks WHERE flag = 'N' AND market_id NOT IN (SELECT market_id FROM ticks WHERE flag = 'A')")
def preferred_series(spark, sf):
    t = ticks(spark, sf).select("market_id", "price", "ts", "flag")
    return quality.prefer(t.filter("flag = 'A'"), t.filter("flag = 'N'"), "market_id").drop("flag")


@query(", r AS (SELECT market_id, price, row_number() OVER (PARTITION BY market_id ORDER BY ts DESC, ord DESC, price DESC) AS n FROM ticks) SELECT market_id, max(price) FILTER (WHERE n = 1) AS latest, round(max(price) FILTER (WHERE n = 1) - max(price) FILTER (WHERE n = 2), 6) AS last_change FROM r GROUP BY 1")
def last_changes(spark, sf):
    return rounded(quality.latest_two(ticks(spark, sf), "market_id", "ts", "price", ["ord", "price"]), "last_change")


@query(", a AS (SELECT market_id, volume_usd AS v FROM markets WHERE market_id % 3 <> 0), b AS (SELECT market_id, CASE WHEN market_id % 2 = 0 THEN volume_usd + 1 ELSE volume_usd END AS v FROM markets WHERE market_id % 5 <> 0) SELECT coalesce(a.market_id, b.market_id) AS market_id, CASE WHEN a.market_id IS NULL THEN 'added' WHEN b.market_id IS NULL THEN 'removed' ELSE 'changed' END AS change, a.v AS old, b.v AS new FROM a FULL JOIN b USING (market_id) WHERE a.v IS DISTINCT FROM b.v")
def change_log(spark, sf):
    m = markets(spark, sf).select("market_id", "volume_usd")
    today = m.filter("market_id % 5 <> 0").withColumn("volume_usd", F.when(F.col("market_id") % 2 == 0, F.col("volume_usd") + 1).otherwise(F.col("volume_usd")))
    return quality.changes(today, m.filter("market_id % 3 <> 0"), "market_id", "volume_usd")


@query(", s AS (SELECT market_id, platform AS a, CASE WHEN wallet % 3 = 0 THEN 'kalshi' ELSE 'polymarket' END AS b, CASE WHEN wallet % 5 <> 0 THEN category END AS c FROM markets) SELECT market_id, CASE WHEN a = b THEN a WHEN a = c THEN a WHEN b = c THEN b ELSE a END AS voted, CAST(CASE WHEN a = b OR a = c OR b = c THEN 2 ELSE 1 END AS INTEGER) AS votes FROM s")
def stage_votes(spark, sf):
    s = markets(spark, sf).select("market_id", F.col("platform").alias("a"), F.when(F.col("wallet") % 3 == 0, "kalshi").otherwise("polymarket").alias("b"), F.when(F.col("wallet") % 5 != 0, F.col("category")).alias("c"))
    return quality.vote(s, ["a", "b", "c"]).select("market_id", "voted", "votes")


@query(_QUESTIONS + " SELECT market_id, question FROM q WHERE contains(lower(question || ' ' || category || ' ' || platform), 'senate') AND contains(lower(question || ' ' || category || ' ' || platform), 'kalshi')")
def monitor_filter(spark, sf):
    return questions(spark, sf).filter(search.contains_all("Senate kalshi", [F.col("question"), F.col("category"), F.col("platform")])).select("market_id", "question")


@query(_QUESTIONS + " SELECT market_id, question FROM q WHERE contains(lower(question), 'urgent') OR contains(lower(category), 'urgent')")
def search_any(spark, sf):
    return questions(spark, sf).filter(search.contains_any("URGENT", [F.col("question"), F.col("category")])).select("market_id", "question")


@query("SELECT market_id, platform, volume_usd FROM markets WHERE platform = 'kalshi' ORDER BY volume_usd DESC, market_id LIMIT 50 OFFSET 100")
def market_page(spark, sf):
    return search.page(markets(spark, sf), {"platform": "kalshi"}, [F.desc("volume_usd"), F.col("market_id")], 50, 100).select("market_id", "platform", "volume_usd")


@query(", c AS (SELECT market_id, (SELECT 1) AS one, max(price) FILTER (WHERE n = 1) - max(price) FILTER (WHERE n = 2) AS d FROM (SELECT market_id, price, row_number() OVER (PARTITION BY market_id ORDER BY ts DESC, ord DESC, price DESC) AS n FROM ticks) GROUP BY 1), s AS (SELECT market_id, volume_usd, abs(d) * pow(log10(greatest(volume_usd, 1)), 3) AS score FROM c JOIN markets USING (market_id) WHERE d IS NOT NULL AND volume_usd >= 100000) SELECT market_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, market_id LIMIT 25")
def biggest_moves(spark, sf):
    c = quality.latest_two(ticks(spark, sf), "market_id", "ts", "price", ["ord", "price"]).join(markets(spark, sf).select("market_id", "volume_usd"), "market_id")
    return rounded(search.biggest_moves(c, "last_change", "volume_usd", "market_id", 1e5, 25), "score").select("market_id", "score")


@query(", b AS (SELECT wallet % 100 AS slug, (array_agg(market_id ORDER BY volume_usd DESC, market_id))[1] AS market_id, max(volume_usd) AS volume_usd FROM markets GROUP BY 1) SELECT * FROM b ORDER BY volume_usd DESC, market_id LIMIT 20")
def highest_volume(spark, sf):
    m = markets(spark, sf).select((F.col("wallet") % 100).alias("slug"), "market_id", "volume_usd")
    return search.highest_volume(m, "slug", "volume_usd", "market_id", 20)


@query(", v AS (SELECT platform, category || '-' || wallet % 50 AS k, avg(p) AS p FROM predictions JOIN (SELECT market_id, wallet FROM markets) USING (market_id) GROUP BY 1, 2) SELECT a.k AS k, floor(a.p * 1000000 + 0.500001) / 1000000 AS a, floor(b.p * 1000000 + 0.500001) / 1000000 AS b, floor(abs(a.p - b.p) * 1000000 + 0.500001) / 1000000 AS spread FROM v a JOIN v b ON a.k = b.k AND a.platform = 'polymarket' AND b.platform = 'kalshi' WHERE abs(a.p - b.p) > 0.050000001".replace("wallet % 50", "(wallet // 2) % 50"))
def divergences(spark, sf):
    p = predictions(spark, sf).join(markets(spark, sf).select("market_id", "wallet"), "market_id")
    v = p.groupBy("platform", F.concat_ws("-", "category", (F.floor(F.col("wallet") / 2) % 50).cast("string")).alias("k")).agg(F.avg("p").alias("p"))
    return search.divergences(v.filter("platform = 'polymarket'"), v.filter("platform = 'kalshi'"), "k", "p").withColumns({c: numbers.half_up(F.col(c), 6) for c in ("a", "b", "spread")})


@query(", r AS (SELECT market_id, volume_usd, row_number() OVER (ORDER BY volume_usd DESC, market_id) AS n FROM markets) SELECT market_id, volume_usd, CASE WHEN n <= 50 THEN 1 ELSE 2 END AS tier FROM r WHERE n <= 550")
def volume_tiers(spark, sf):
    return search.tiers(markets(spark, sf).select("market_id", "volume_usd"), "volume_usd", "market_id")


@query(", t AS (SELECT category FROM markets GROUP BY 1 ORDER BY sum(volume_usd) DESC, 1 LIMIT 2) SELECT category, count(*) AS n FROM markets WHERE category IN (SELECT category FROM t) OR category = '5-LOW' GROUP BY 1")
def top_categories(spark, sf):
    return search.top_groups(markets(spark, sf), "category", "volume_usd", 2, ["5-LOW"]).groupBy("category").agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (WHERE a AND b) AS shared, count(*) FILTER (WHERE a OR b) AS either, count(*) FILTER (WHERE a AND NOT b) AS only_a FROM (SELECT wallet, bool_or(platform = 'kalshi' OR market_id % 3 = 0) AS a, bool_or(market_id % 2 = 0) AS b FROM markets GROUP BY 1)")
def set_algebra(spark, sf):
    m = markets(spark, sf)
    a, b = m.filter("platform = 'kalshi' OR market_id % 3 = 0").select("wallet"), m.filter("market_id % 2 = 0").select("wallet")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(a.intersect(b), "shared").crossJoin(n(a.union(b).distinct(), "either")).crossJoin(n(a.subtract(b), "only_a"))
