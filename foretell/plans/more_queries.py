"""Further queries: labels, hints, races, leaders, summaries, binned curves and category tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretell.functions import text as tx
from foretell.functions.numbers import corr
from foretell.functions.subjects import NOT_POLITICAL, POLITICAL_WORDS
from foretell.operators import binning, book, elections, frames, matching, patterns, pricing, quality, ranks, scoring, search_index, stats
from foretell.plans.domain_queries import _BOOK, _QUESTIONS, books, questions
from foretell.plans.market_queries import LAST, day_one, predictions, rounded
from foretell.plans.registry import registry
from foretell.plans.views import DAY, PRELUDE, markets, table, ticks
from foretell.sources import readers, snapshots
from foretell.sources.shared import shared_dir, written

query, QUERIES, SQL = registry(PRELUDE)


_OFFICES = ["President", "Senate", "Mayor", "Prime Minister", "Attorney General", "Regional", "Other"]
_CASE = lambda table: " ".join(f"WHEN office = '{k}' THEN CASE WHEN pri THEN '{b}' ELSE '{a}' END" for k, (a, b) in table.items())


@query(f", o AS (SELECT ({_OFFICES})[market_id % 7 + 1] AS office, market_id % 2 = 0 AS pri, market_id % 3 = 0 AS us FROM markets) SELECT office, pri, us, coalesce(CASE WHEN us THEN CASE {_CASE(tx.US_TYPES)} END ELSE coalesce(CASE {_CASE(tx.OTHER_TYPES)} END, 'OTHER_NEEDS_REVIEW') END, 'none') AS election_type, count(*) AS n FROM o GROUP BY ALL")
def election_types(spark, sf):
    o = markets(spark, sf).select(F.element_at(F.array(*map(F.lit, _OFFICES)), (F.col("market_id") % 7 + 1).cast("int")).alias("office"), (F.col("market_id") % 2 == 0).alias("pri"), (F.col("market_id") % 3 == 0).alias("us"))
    kind = tx.election_type(F.col("office"), F.col("pri"), F.when(F.col("us"), "United States").otherwise("France"))
    return o.groupBy("office", "pri", "us", F.coalesce(kind, F.lit("none")).alias("election_type")).agg(F.count("*").alias("n"))


_TICKERS = ["KXCOLOMBIAPRES-26-ICAS", "SENATEMD-28-R", "HOUSEPA10-24-R", "KXFINLANDPARLI-27-LEFT", "GOVOH-2026-D", "KXFED-25NOV05"]


@query(", t(k, ticker, office, scope, year, party, country) AS (VALUES (0, 'KXCOLOMBIAPRES-26-ICAS', 'PRES', NULL, 2026, NULL, 'CO'), (1, 'SENATEMD-28-R', 'SEN', 'MD', 2028, 'GOP', 'US'), (2, 'HOUSEPA10-24-R', 'HOUSE', 'PA-10', 2024, 'GOP', 'US'), (3, 'KXFINLANDPARLI-27-LEFT', 'PARL', NULL, 2027, 'LEFT', 'FI'), (4, 'GOVOH-2026-D', 'GOV', 'OH', 2026, 'DEM', 'US'), (5, 'KXFED-25NOV05', NULL, NULL, 2025, NULL, NULL)) SELECT ticker, coalesce(office, '-') AS office, coalesce(scope, '-') AS scope, year, coalesce(party, '-') AS party, coalesce(country, '-') AS country, count(*) AS n FROM markets m JOIN t ON m.market_id % 6 = t.k GROUP BY ALL")
def ticker_hints(spark, sf):
    t = markets(spark, sf).select("market_id", F.element_at(F.array(*map(F.lit, _TICKERS)), (F.col("market_id") % 6 + 1).cast("int")).alias("ticker"))
    return t.groupBy("ticker", tx.ticker_fields(F.col("ticker")).alias("f")).agg(F.count("*").alias("n")).select("ticker", "f.*", "n").na.fill("-")


#: Titles by market_id, with the year of the close in place of Y.
_TITLES = [
    "Will the Chiefs win the Y Super Bowl?", "Over/under on points in game 7", "Will the senate vote on the NBA bill in Y?", "Who is next Head Coach of the Jets?", "Lakers vs Celtics: Winner?", "Will T1 win the Y Worlds?", "Will Bitcoin be above $100000 in Y?", "BTC dominance over 60%?",
    "Will TSLA stock close above 300 in Y?", "S&P 500 to hit $7000 in Y?", "WTI crude above 90?", "Gold (GC) settle over 3000?", "Best Picture: will Dune win the award?", "Box office of the year Y", "New single: release a new album in Y?", "Big Brother winner of Y?", "Big Brother and surveillance in China",
    "OpenAI worth $900B in Y?", "Which is the best AI model in Y?", "Reach 200 Million subscribers by Y?", "Will she be engaged in Y?", "At least 3 inches of snow in Y", "GTA VI before ceasefire?", "GTA VI released in Y?", "Charizard over $500?", "How often will Elon tweet?", "TSA passengers in May Y",
    "Eurovision Y: Sweden?", "Magnitude 8 earthquake? Any earthquakes of magnitude 8 in Y", "Cloudflare outage in Y?", "Harvard university to cancel exams", "Yes Mahomes Rushes,yes", "Hottest summer on record?", "Will it rain at noon?", "A ban on MrBeast?", "Will Y be a leap year?",
]
_TITLE_SQL = ", q AS (SELECT market_id, replace((" + str(_TITLES).replace("\"", "'") + ")[market_id % 36 + 1], 'Y', CAST(2024 + close_ts // 86400 % 6 AS VARCHAR)) AS question FROM markets)"


def _matches_sql(pattern: str) -> str:
    """A pattern as SQL; DuckDB's regular expressions have no `not followed by`."""
    quoted = pattern.replace("'", "''")
    base, _, rest = quoted.partition("(?!")
    one = f"regexp_matches(question, '(?i){base}')"
    return one if not rest else f"({one} AND NOT regexp_matches(question, '(?i){base}{rest[:-1]}'))"


@query(_TITLE_SQL + rf", r AS (SELECT question, CASE WHEN regexp_matches(question, '(?i)\b({'|'.join(POLITICAL_WORDS)})\b') THEN 'kept' " + " ".join(f"WHEN {_matches_sql(p)} THEN '{reason}'" for p, reason in NOT_POLITICAL) + " ELSE 'kept' END AS reason FROM q) SELECT question, reason, count(*) AS n FROM r GROUP BY 1, 2")
def prefilter(spark, sf):
    title = F.element_at(F.array(*map(F.lit, _TITLES)), (F.col("market_id") % 36 + 1).cast("int"))
    q = written(markets(spark, sf).groupBy(F.replace(title, F.lit("Y"), (2024 + F.floor(F.col("close_ts") / DAY) % 6).cast("string")).alias("question")).agg(F.count("*").alias("n")))
    return q.join(patterns.not_political(q, "question"), "question", "left").select("question", F.coalesce("reason", F.lit("kept")).alias("reason"), "n")


@query("SELECT category, array_to_string(list_transform(string_split(lower(regexp_replace(category, '^\\d+[.-]\\s*', '')), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS label, count(*) AS n FROM markets GROUP BY 1, 2")
def category_labels(spark, sf):
    return markets(spark, sf).groupBy("category", tx.category_label(F.col("category")).alias("label")).agg(F.count("*").alias("n"))


_STATES = {"oh": "ohio", "pa": "pennsylvania", "tx": "texas", "wi": "wisconsin", "nm": "new mexico", "va": "virginia", "wv": "west virginia", "az": "arizona"}
#: Markets whose texts name a state by name or by code and a year; elections by supplier, every 20th national.
_RACES = f"""
, s AS (SELECT {list(_STATES)} AS codes, {list(_STATES.values())} AS names),
m AS (SELECT market_id AS key, CASE WHEN market_id % 3 = 0 THEN names[wallet % 8 + 1] || ' Senate' END AS label,
             'Will a Democrat win ' || CASE WHEN market_id % 3 = 0 THEN 'it' WHEN market_id % 3 = 1 THEN upper(names[wallet % 8 + 1]) ELSE upper(codes[wallet % 8 + 1]) || '-0' || market_id % 9 END || ' in ' || (1970 + close_ts // 31557600 + 30) || '?' AS question FROM markets, s),
e AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 20 = 0 THEN 'Presidential Election' ELSE 'Primary ' || s_suppkey END AS name, CASE WHEN s_suppkey % 20 > 0 THEN upper(codes[s_nationkey % 8 + 1]) END AS state,
             CASE WHEN s_suppkey % 7 > 0 THEN (2022 + s_suppkey % 7) || '-11-05' END AS day FROM supplier, s),
n AS (SELECT upper(unnest(codes)) AS code, unnest(names) AS name FROM s)
"""


def _race_tables(spark, sf):
    codes, names = (F.array(*map(F.lit, x)) for x in (list(_STATES), list(_STATES.values())))
    of = lambda side, c: F.get(side, (F.col(c) % 8).cast("int"))
    kind, year = F.col("market_id") % 3, (2000 + F.floor(F.col("close_ts") / 31557600)).cast("string")
    named = F.when(kind == 0, "it").when(kind == 1, F.upper(of(names, "wallet"))).otherwise(F.concat(F.upper(of(codes, "wallet")), F.lit("-0"), (F.col("market_id") % 9).cast("string")))
    m = markets(spark, sf).select(F.col("market_id").alias("key"), F.when(kind == 0, F.concat(of(names, "wallet"), F.lit(" Senate"))).alias("label"), F.concat(F.lit("Will a Democrat win "), named, F.lit(" in "), year, F.lit("?")).alias("question"))
    id_ = F.col("s_suppkey")
    e = table(spark, sf, "supplier").select(
        id_.alias("id"), F.when(id_ % 20 == 0, "Presidential Election").otherwise(F.concat(F.lit("Primary "), id_.cast("string"))).alias("name"),
        F.when(id_ % 20 > 0, F.upper(of(codes, "s_nationkey"))).alias("state"), F.when(id_ % 7 > 0, F.concat((2022 + id_ % 7).cast("string"), F.lit("-11-05"))).alias("day"),
    )
    states = spark.createDataFrame([(c.upper(), n) for c, n in _STATES.items()], "code string, name string")
    return e, m, states


@query(_RACES + """, t AS (SELECT key, lower(coalesce(label, '')) AS label, lower(coalesce(question, '')) AS question FROM m),
a AS (SELECT id, lower(state) AS code, n.name AS place, year, lower(e.name) LIKE '%presidential%' OR lower(e.name) LIKE '%general election%' AS national FROM (SELECT *, day[1:4] AS year FROM e WHERE day IS NOT NULL) e LEFT JOIN n ON e.state = n.code),
b AS (SELECT DISTINCT code, place, year, national FROM a),
x AS (SELECT b.*, t.key FROM b JOIN t ON (contains(label, year) OR contains(question, year)) AND (national OR contains(label, code) OR contains(question, code) OR contains(label, place) OR contains(question, place)))
SELECT id, count(*) AS n, min(key) AS first_key, max(key) AS last_key FROM a JOIN x ON a.year = x.year AND a.national = x.national AND a.code IS NOT DISTINCT FROM x.code GROUP BY 1""")
def elections_by_place(spark, sf):
    return elections.match_by_text(*_race_tables(spark, sf)).groupBy("id").agg(F.count("*").alias("n"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


@query(""", m AS (SELECT market_id AS key, wallet % 25 AS state, CASE WHEN market_id % 5 > 0 THEN CAST(2024 + market_id % 3 AS INTEGER) END AS year FROM markets),
r AS (SELECT s_name AS race, s_nationkey AS state, CASE WHEN s_suppkey % 4 > 0 THEN CAST(2023 + s_suppkey % 4 AS INTEGER) END AS ry, s_acctbal AS ord FROM supplier)
SELECT key, arg_min(race, {'o': ord, 'r': race}) AS race FROM m JOIN r USING (state) WHERE year IS NULL OR ry IS NULL OR year = ry GROUP BY 1""")
def race_context(spark, sf):
    m = markets(spark, sf).select(F.col("market_id").alias("key"), (F.col("wallet") % 25).cast("int").alias("state"), F.when(F.col("market_id") % 5 > 0, 2024 + F.col("market_id") % 3).cast("int").alias("year"))
    id_ = F.col("s_suppkey")
    r = table(spark, sf, "supplier").select(F.col("s_name").alias("race"), F.col("s_nationkey").cast("int").alias("state"), F.when(id_ % 4 > 0, 2023 + id_ % 4).cast("int").alias("race_year"), F.col("s_acctbal").alias("ord"))
    return elections.race_context(m, r)


@query(", c AS (SELECT category AS election, 'N' || wallet % 9 AS name_slug, platform, market_id, p AS price FROM predictions JOIN (SELECT market_id, wallet FROM markets) USING (market_id) WHERE days = 1), n AS (SELECT election, name_slug, avg(price) AS price, (array_agg(market_id ORDER BY c.price DESC, market_id) FILTER (WHERE platform = 'polymarket'))[1] AS polymarket, (array_agg(market_id ORDER BY c.price DESC, market_id) FILTER (WHERE platform = 'kalshi'))[1] AS kalshi FROM c GROUP BY 1, 2) SELECT election, name_slug, round(price, 6) AS price, coalesce(polymarket, -1) AS polymarket, coalesce(kalshi, -1) AS kalshi FROM n QUALIFY row_number() OVER (PARTITION BY election ORDER BY n.price DESC, name_slug DESC) = 1")
def leading_candidates(spark, sf):
    d = day_one(spark, sf).join(markets(spark, sf).select("market_id", "wallet"), "market_id")
    c = d.select(F.col("category").alias("election"), F.concat(F.lit("N"), (F.col("wallet") % 9).cast("string")).alias("name_slug"), "platform", "market_id", F.col("p").alias("price"))
    return rounded(elections.leader(c, "election"), "price").na.fill(-1, ["polymarket", "kalshi"])


@query("SELECT market_id FROM markets WHERE close_ts > 0 AND close_ts < 820454400 AND outcome IS NULL")
def stale_markets(spark, sf):
    m = markets(spark, sf).withColumn("status", F.lit("open"))
    return quality.stale(m, 820454400, result="outcome").select("market_id")


@query("SELECT market_id, CASE WHEN market_id % 3 = 0 THEN platform ELSE category END AS category FROM markets")
def hint_override(spark, sf):
    m = markets(spark, sf).withColumn("sure", F.when(F.col("market_id") % 3 == 0, "high").otherwise("low"))
    return quality.override(m, "category", "platform", "sure").select("market_id", "category")


@query("SELECT platform, count(*) AS n, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories, min(market_id) AS first_id FROM markets WHERE close_ts >= 883612800 GROUP BY 1")
def daily_summary(spark, sf):
    return quality.daily_summary(markets(spark, sf), "close_ts", "market_id", 883612800).withColumn("categories", F.array_join("categories", ","))


@query(_BOOK + " SELECT floor((a.best_bid_m + a.best_ask_m) / 2 * 10000 + 0.500001) / 10000 AS midpoint, a.g AS g FROM (SELECT market_id % 10 AS g, max(best_bid) AS best_bid_m, min(best_ask) AS best_ask_m FROM b GROUP BY 1) a")
def combined_midpoints(spark, sf):
    return book.combined_midpoints(books(spark, sf), [(F.col("market_id") % 10).alias("g")])


@query(", d AS (SELECT *, (p - outcome) * (p - outcome) AS b FROM predictions WHERE days = 1), r AS (SELECT b, (rank() OVER (ORDER BY volume_usd) + (count(*) OVER (PARTITION BY volume_usd) - 1) / 2.0) / count(*) OVER () AS pct FROM d), k AS (SELECT b, len(list_filter(range(51), lambda i: CAST(i AS DOUBLE) / 50 < pct)) - 1 AS bin FROM r) SELECT bin, count(*) AS n, round(avg(b), 6) AS brier FROM k GROUP BY 1")
def liquidity_curve(spark, sf):
    d = ranks.rank_pct(day_one(spark, sf).withColumn("b", scoring.brier(F.col("p"), F.col("outcome"))), "volume_usd", "pct")
    return rounded(d.groupBy(binning.cut(F.col("pct"), [k / 50 for k in range(51)], True).alias("bin")).agg(F.count("*").alias("n"), F.avg("b").alias("brier")), "brier")


@query(", q AS (SELECT list_distinct(quantile_cont(p, [0.0, 1.0 / 3, 2.0 / 3, 1.0])) AS e FROM predictions WHERE days = 1), t AS (SELECT greatest(len(list_filter(e, lambda x: x < p)) - 1, 0) AS tier, p, outcome FROM predictions, q WHERE days = 1) SELECT tier, count(*) AS n, round(avg((p - outcome) * (p - outcome)), 6) AS brier FROM t GROUP BY 1")
def confidence_tiers(spark, sf):
    d = binning.quantile_bins(day_one(spark, sf), "p", 3, "tier")
    return rounded(d.groupBy("tier").agg(F.count("*").alias("n"), F.avg(scoring.brier(F.col("p"), F.col("outcome"))).alias("brier")), "brier")


@query(", s AS (SELECT category, days, platform, avg((p - outcome) * (p - outcome)) AS b, count(*) AS n FROM predictions GROUP BY 1, 2, 3), w AS (SELECT category, days, max(b) FILTER (WHERE platform = 'polymarket') AS pm, max(b) FILTER (WHERE platform = 'kalshi') AS k, max(n) FILTER (WHERE platform = 'polymarket') AS np, max(n) FILTER (WHERE platform = 'kalshi') AS nk FROM s GROUP BY 1, 2) SELECT category, days, round(pm, 6) AS pm, round(k, 6) AS k, CASE WHEN pm < k THEN 'polymarket' WHEN pm > k THEN 'kalshi' ELSE 'tie' END AS winner FROM w WHERE np >= 10 AND nk >= 10 AND np + nk >= 20")
def category_winners(spark, sf):
    p = predictions(spark, sf).withColumn("b", scoring.brier(F.col("p"), F.col("outcome")))
    of = lambda v, c: F.when(F.col("platform") == v, c)
    w = p.groupBy("category", "days").agg(F.avg(of("polymarket", F.col("b"))).alias("pm"), F.avg(of("kalshi", F.col("b"))).alias("k"), F.count(of("polymarket", F.lit(1))).alias("np"), F.count(of("kalshi", F.lit(1))).alias("nk"))
    w = w.filter("np >= 10 AND nk >= 10 AND np + nk >= 20").withColumn("winner", F.when(F.col("pm") < F.col("k"), "polymarket").when(F.col("pm") > F.col("k"), "kalshi").otherwise("tie"))
    return rounded(w, "pm", "k").select("category", "days", "pm", "k", "winner")


@query(", t AS (SELECT unnest([0.0, 1000.0, 10000.0, 100000.0, 250000.0]) AS threshold) SELECT CAST(threshold AS DOUBLE) AS threshold, platform, count(*) AS n, round(avg((p - outcome) * (p - outcome)), 6) AS brier FROM predictions, t WHERE days = 1 AND volume_usd >= threshold GROUP BY 1, 2")
def threshold_curve(spark, sf):
    d = day_one(spark, sf).withColumn("threshold", F.explode(F.array(*map(F.lit, [0.0, 1e3, 1e4, 1e5, 2.5e5])))).filter("volume_usd >= threshold")
    return rounded(d.groupBy("threshold", "platform").agg(F.count("*").alias("n"), F.avg(scoring.brier(F.col("p"), F.col("outcome"))).alias("brier")), "brier")


@query(f", w AS (SELECT k.market_id, {LAST} AS spot, avg(price) FILTER (WHERE t.ts >= k.close_ts - 2592000) AS m FROM markets k JOIN ticks t ON t.market_id = k.market_id AND t.ts <= k.close_ts GROUP BY 1) SELECT round(corr(spot, coalesce(m, spot)), 6) AS r, round(avg(abs(spot - coalesce(m, spot))), 6) AS mae, count(*) AS n FROM w")
def spot_against_mean(spark, sf):
    w = pricing.window_means(markets(spark, sf).select("market_id", "close_ts"), ticks(spark, sf), "close_ts", {"spot": -1, "mean": 30 * DAY}).filter(F.col("spot").isNotNull())
    return rounded(w.agg(corr("spot", "mean").alias("r"), F.avg(F.abs(F.col("spot") - F.col("mean"))).alias("mae"), F.count("*").alias("n")), "r", "mae")


@query(", s AS (SELECT market_id, p, days FROM predictions WHERE days IN (1, 7)) SELECT a.market_id, a.p AS day_1, b.p AS day_7, round(a.p - b.p, 6) AS moved FROM s a JOIN s b ON a.market_id = b.market_id AND a.days = 1 AND b.days = 7")
def horizon_moves(spark, sf):
    p = predictions(spark, sf)
    a, b = p.filter("days = 1").select("market_id", F.col("p").alias("day_1")), p.filter("days = 7").select("market_id", F.col("p").alias("day_7"))
    return rounded(a.join(b, "market_id").withColumn("moved", F.col("day_1") - F.col("day_7")), "moved")


@query(", r AS (SELECT volume_usd, (p - outcome) * (p - outcome) - p * (1 - p) AS rb FROM predictions WHERE days = 1) SELECT round(corr(rb, volume_usd), 6) AS with_volume, round(corr(rb, ln(volume_usd)), 6) AS with_log_volume FROM r")
def residual_correlations(spark, sf):
    d = day_one(spark, sf).withColumn("rb", stats.residual_brier(F.col("p"), F.col("outcome")))
    return rounded(d.agg(corr("rb", "volume_usd").alias("with_volume"), corr("rb", F.log("volume_usd")).alias("with_log_volume")), "with_volume", "with_log_volume")


@query(", m AS (SELECT market_id, 0.5 + (market_id % 51) / 100.0 AS confidence, market_id % 100 AS kp, (market_id % 7) / 10.0 AS pp, (market_id % 11) / 10.0 AS ks FROM markets) SELECT count(*) AS matches, round(avg(confidence), 6) AS mean_confidence, count(*) FILTER (WHERE confidence >= 0.9) AS high, count(*) FILTER (WHERE confidence >= 0.75 AND confidence < 0.9) AS medium, count(*) FILTER (WHERE confidence < 0.75) AS low FROM m".replace("0.5 + (market_id % 51) / 100.0", "CAST(0.5 + (market_id % 51) / 128.0 AS DOUBLE)"))
def match_statistics(spark, sf):
    m = markets(spark, sf).select((0.5 + (F.col("market_id") % 51) / 128.0).alias("confidence"))
    return rounded(matching.statistics(m), "mean_confidence")


@query("SELECT market_id, CASE WHEN abs(CASE WHEN market_id % 100 > 1 THEN (market_id % 100) / 100.0 ELSE market_id % 100 END - (market_id % 8) / 8.0) > 0.25 THEN 'price gap' ELSE '' END AS warnings FROM markets")
def match_warnings(spark, sf):
    m = markets(spark, sf).select("market_id", (F.col("market_id") % 100).cast("double").alias("k_price"), ((F.col("market_id") % 8) / 8.0).alias("p_price"), F.lit(0.9).alias("k_sure"), F.lit(0.9).alias("p_sure"))
    return matching.validate(m).select("market_id", F.array_join("warnings", ",").alias("warnings"))


@query(f", l AS (SELECT market_id, {LAST} AS price FROM ticks GROUP BY 1), b AS (SELECT m.market_id, m.platform, l.price FROM markets m JOIN l USING (market_id)) SELECT platform, count(*) AS n, round(avg(price), 6) AS mean FROM b GROUP BY 1")
def latest_price_by_platform(spark, sf):
    last = ticks(spark, sf).groupBy("market_id").agg(F.max_by("price", F.struct("ts", "ord", "price")).alias("price"))
    j = markets(spark, sf).join(last, "market_id")
    return rounded(j.groupBy("platform").agg(F.count("*").alias("n"), F.avg("price").alias("mean")), "mean")


#: The ten fields of a listing entry that a filter looks in.
_FIELDS = ["label", "pm_question", "k_question", "location", "country", "office", "party", "type", "pm_candidate", "k_candidate"]
_ENTRIES = _TITLE_SQL + f"""
, f AS (SELECT m.market_id, CASE WHEN market_id % 3 = 0 THEN NULL ELSE q.question END AS label, CASE WHEN platform = 'polymarket' THEN q.question END AS pm_question, CASE WHEN platform = 'kalshi' THEN q.question END AS k_question, ({list(_STATES.values())})[wallet % 8 + 1] AS location,
  CASE WHEN market_id % 2 = 0 THEN 'United States' END AS country, (['Senate', 'House', 'Governor'])[market_id % 3 + 1] AS office, (['Democrat', 'Republican'])[wallet % 2 + 1] AS party, category AS type,
  CASE WHEN platform = 'polymarket' THEN 'Candidate ' || wallet END AS pm_candidate, CASE WHEN platform = 'kalshi' THEN 'Runner ' || wallet END AS k_candidate FROM markets m JOIN q USING (market_id)),
h AS (SELECT *, lower(concat_ws(' ', {", ".join(f"coalesce({f}, '')" for f in _FIELDS)})) AS hay FROM f)
"""


def _entries(spark, sf):
    m = markets(spark, sf)
    title = F.element_at(F.array(*map(F.lit, _TITLES)), (F.col("market_id") % 36 + 1).cast("int"))
    q = F.replace(title, F.lit("Y"), (2024 + F.floor(F.col("close_ts") / DAY) % 6).cast("string"))
    of = lambda values, by: F.get(F.array(*map(F.lit, values)), (F.col(by) % len(values)).cast("int"))
    on, number = (lambda v, x: F.when(F.col("platform") == v, x)), F.col("wallet").cast("string")
    values = [
        F.when(F.col("market_id") % 3 != 0, q), on("polymarket", q), on("kalshi", q), of(list(_STATES.values()), "wallet"), F.when(F.col("market_id") % 2 == 0, "United States"), of(["Senate", "House", "Governor"], "market_id"),
        of(["Democrat", "Republican"], "wallet"), F.col("category"), on("polymarket", F.concat(F.lit("Candidate "), number)), on("kalshi", F.concat(F.lit("Runner "), number)),
    ]
    return m.select("market_id", *[v.alias(f) for v, f in zip(values, _FIELDS)])


_ASKED = ["super BOWL 2026", "candidate 12", "runner unner 1-urg", "at", "nothing of this kind", "mexico house democrat"]


@query(_ENTRIES + " UNION ALL ".join(f"SELECT '{a}' AS query, market_id FROM h WHERE " + " AND ".join(f"contains(hay, '{w}')" for w in a.lower().split()) for a in _ASKED))
def indexed_filter(spark, sf):
    """All words, somewhere in ten fields."""
    index = search_index.SearchIndex.build(_entries(spark, sf), "market_id", _FIELDS, f"{shared_dir(spark)}/i-{uuid.uuid4().hex}")
    found = [index.all_words(a).select(F.lit(a).alias("query"), "market_id") for a in _ASKED]
    return reduce(DataFrame.unionByName, found)


_PHRASES = ["Senate", "win the 2027 super", "New mexico", "CANDIDATE 7", "o"]


@query(_ENTRIES + " UNION ALL ".join(f"SELECT '{a}' AS query, market_id FROM f WHERE " + " OR ".join(f"coalesce(contains(lower({x}), '{a.lower()}'), false)" for x in _FIELDS) for a in _PHRASES))
def indexed_search(spark, sf):
    """A phrase, inside one of ten fields."""
    index = search_index.SearchIndex.build(_entries(spark, sf), "market_id", _FIELDS, f"{shared_dir(spark)}/i-{uuid.uuid4().hex}")
    return reduce(DataFrame.unionByName, [index.phrase(a).select(F.lit(a).alias("query"), "market_id") for a in _PHRASES])


@query("""WITH RECURSIVE p AS (SELECT c_custkey // 40 AS n, c_custkey, c_name, (SELECT max(c_custkey // 40) FROM customer) AS last FROM customer),
chain(n, place) AS (SELECT 0, 0 UNION ALL SELECT n + 1, place + 1 FROM chain WHERE n < (SELECT max(last) FROM p))
SELECT place AS page, CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM chain JOIN p USING (n)""", prelude="")
def cursor_scan(spark, sf):
    """Pages of a listing by their cursors, from the first to the last; every seventh page has a twin under a cursor that no page names."""
    at = f"{shared_dir(spark)}/c-{uuid.uuid4().hex}"
    c = table(spark, sf, "customer").select(F.floor(F.col("c_custkey") / 40).alias("n"), F.struct(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name")).alias("item"))
    last = c.agg(F.max("n").alias("last"))
    cursor = lambda n: F.md5(F.concat(F.lit("page "), n.cast("string")))
    pages = c.groupBy("n").agg(F.to_json(F.collect_list("item")).alias("items")).crossJoin(F.broadcast(last))
    pages = pages.select("n", cursor(F.col("n")).alias("cursor"), F.when(F.col("n") < F.col("last"), cursor(F.col("n") + 1)).alias("next_cursor"), "items")
    lost = pages.filter("n % 7 = 3").withColumn("cursor", F.concat(F.lit("lost "), F.col("cursor")))
    pages.unionByName(lost).select("cursor", "next_cursor", "items").write.json(at)
    first = spark.range(1).select(cursor(F.lit(0)).alias("c")).first()["c"]
    got = readers.cursor_pages(spark, at, first)
    return got.select("page", "id", F.get_json_object("payload", "$.name").alias("name"))


_VERSIONS_SQL = """
, v1 AS (SELECT market_id, platform, CAST(NULL AS VARCHAR) AS category, CAST(NULL AS VARCHAR) AS party, CAST(NULL AS INTEGER) AS outcome FROM markets WHERE market_id % 3 <> 0),
v2 AS (SELECT market_id, platform, CASE WHEN market_id % 4 > 0 THEN category END AS category, CASE WHEN market_id % 5 = 0 THEN 'R' END AS party, CASE WHEN market_id % 6 = 0 THEN outcome END AS outcome FROM markets WHERE market_id % 7 <> 0),
v3 AS (SELECT market_id, platform, CASE WHEN market_id % 8 > 0 THEN category ELSE 'moved' END AS category, CASE WHEN market_id % 5 = 0 THEN 'R' WHEN market_id % 5 = 1 THEN 'D' END AS party, outcome FROM markets)
"""


def _versions(spark, sf):
    m, k = markets(spark, sf), F.col("market_id")
    none = lambda kind: F.lit(None).cast(kind)
    first = m.filter(k % 3 != 0).select(k, "platform", none("string").alias("category"), none("string").alias("party"), none("int").alias("outcome"))
    second = m.filter(k % 7 != 0).select(k, "platform", F.when(k % 4 > 0, F.col("category")).alias("category"), F.when(k % 5 == 0, "R").alias("party"), F.when(k % 6 == 0, F.col("outcome")).alias("outcome"))
    third = m.select(k, "platform", F.when(k % 8 > 0, F.col("category")).otherwise("moved").alias("category"), F.when(k % 5 == 0, "R").when(k % 5 == 1, "D").alias("party"), "outcome")
    kept = snapshots.Snapshots(spark, f"{shared_dir(spark)}/s-{uuid.uuid4().hex}", "market_id")
    for v in (first, second, third):
        kept.save(v)
    return kept


@query(_VERSIONS_SQL + " SELECT market_id, 2 AS version, platform, category, party, outcome FROM v2 UNION ALL SELECT market_id, 3, platform, category, party, outcome FROM v3")
def versions_read_back(spark, sf):
    kept = _versions(spark, sf)
    columns = ["market_id", F.col("version"), "platform", "category", "party", "outcome"]
    return kept.read(2).withColumn("version", F.lit(2)).select(*columns).unionByName(kept.read().withColumn("version", F.lit(3)).select(*columns))


_CELLS = " UNION ALL ".join(f"SELECT market_id, {v} AS version, 'changed' AS change, '{c}' AS \"column\", CAST(a.{c} AS VARCHAR) AS old, CAST(b.{c} AS VARCHAR) AS new FROM v{v - 1} a JOIN v{v} b USING (market_id) WHERE a.{c} IS DISTINCT FROM b.{c}" for v in (2, 3) for c in ("platform", "category", "party", "outcome"))
_EVENTS = f""", d AS ({_CELLS}
UNION ALL SELECT market_id, 1, 'added', NULL, NULL, NULL FROM v1 UNION ALL SELECT market_id, 2, 'added', NULL, NULL, NULL FROM v2 WHERE market_id NOT IN (SELECT market_id FROM v1) UNION ALL SELECT market_id, 3, 'added', NULL, NULL, NULL FROM v3 WHERE market_id NOT IN (SELECT market_id FROM v2)
UNION ALL SELECT market_id, 2, 'removed', NULL, NULL, NULL FROM v1 WHERE market_id NOT IN (SELECT market_id FROM v2))"""


@query(_VERSIONS_SQL + _EVENTS + ' SELECT market_id, version, change, coalesce("column", \'-\') AS "column", coalesce(old, \'-\') AS old, coalesce(new, \'-\') AS new FROM d')
def version_changes(spark, sf):
    return _versions(spark, sf).events(0, 3).select("market_id", "version", "change", "column", "old", "new").na.fill("-")


@query(_VERSIONS_SQL + _EVENTS + """, v AS (SELECT 1 AS version, * FROM v1 UNION ALL SELECT 2, * FROM v2 UNION ALL SELECT 3, * FROM v3)
SELECT version, market_id, 'market_added' AS type, platform || ' | ' || coalesce(category, '') AS details FROM d JOIN v USING (version, market_id) WHERE change = 'added'
UNION ALL SELECT version, market_id, CASE "column" WHEN 'category' THEN 'category_assigned' ELSE 'resolution_set' END, new FROM d WHERE "column" IN ('category', 'outcome') AND new IS NOT NULL
UNION ALL SELECT version, market_id, 'electoral_filled', 'party=' || new FROM d WHERE "column" = 'party' AND old IS NULL AND new IS NOT NULL""")
def typed_change_log(spark, sf):
    kept = _versions(spark, sf)
    rows = reduce(DataFrame.unionByName, [kept.read(v).withColumn("version", F.lit(v)) for v in (1, 2, 3)])
    return snapshots.typed_events(kept.events(0, 3), rows, "market_id", {"category": "category_assigned", "outcome": "resolution_set"}, {"party": "electoral_filled"}, ["platform", "category"])


_PLACES = ["OH", "PA", "TX", "WI", "NM", "VA", "WV", "AZ"]
_ABROAD = {"COLOMBIA": "CO", "FINLAND": "FI", "SOUTHKOREA": "KR", "UK": "GB"}
_SIDES = {"-R": "GOP", "-D": "DEM", "-LEFT": "LEFT", "-ICAS": None, "": None}


@query(f""", p AS (SELECT market_id % 5 AS kind, ({_PLACES})[wallet % 8 + 1] AS place, market_id % 30 + 1 AS seat, ({list(_ABROAD)})[wallet % 4 + 1] AS land, ({list(_ABROAD.values())})[wallet % 4 + 1] AS code, 2024 + market_id % 7 AS year, wallet % 3 AS form, market_id % 11 % 5 + 1 AS side FROM markets),
t AS (SELECT CASE kind WHEN 0 THEN 'SENATE' || place WHEN 1 THEN 'HOUSE' || place || seat WHEN 2 THEN 'KXGOV' || place WHEN 3 THEN 'KX' || land || 'PRES' ELSE 'KX' || land || 'PARLI' END || '-' || CASE form WHEN 0 THEN CAST(year AS VARCHAR) WHEN 1 THEN CAST(year % 100 AS VARCHAR) ELSE year % 100 || 'NOV0' || year % 9 END || ({list(_SIDES)})[side] AS ticker,
  (['SEN', 'HOUSE', 'GOV', 'PRES', 'PARL'])[kind + 1] AS office, CASE WHEN kind = 1 THEN place || '-' || seat WHEN kind < 3 THEN place ELSE '-' END AS scope, year, (['GOP', 'DEM', 'LEFT', '-', '-'])[side] AS party, CASE WHEN kind < 3 THEN 'US' ELSE code END AS country FROM p)
SELECT ticker, office, scope, year, party, country, count(*) AS n FROM t GROUP BY ALL""")
def composed_tickers(spark, sf):
    """Tickers put together from the rows; the SQL knows the parts, the query reads them back from the text."""
    of = lambda values, by: F.get(F.array(*map(F.lit, values)), (by).cast("int"))
    k, w = F.col("market_id"), F.col("wallet")
    place, land, year = of(_PLACES, w % 8), of(list(_ABROAD), w % 4), 2024 + k % 7
    head = F.when(k % 5 == 0, F.concat(F.lit("SENATE"), place)).when(k % 5 == 1, F.concat(F.lit("HOUSE"), place, (k % 30 + 1).cast("string"))).when(k % 5 == 2, F.concat(F.lit("KXGOV"), place)).when(k % 5 == 3, F.concat(F.lit("KX"), land, F.lit("PRES"))).otherwise(F.concat(F.lit("KX"), land, F.lit("PARLI")))
    two = (year % 100).cast("string")
    when = F.when(w % 3 == 0, year.cast("string")).when(w % 3 == 1, two).otherwise(F.concat(two, F.lit("NOV0"), (year % 9).cast("string")))
    t = markets(spark, sf).groupBy(F.concat(head, F.lit("-"), when, of(list(_SIDES), k % 11 % 5)).alias("ticker")).agg(F.count("*").alias("n"))
    return t.select("ticker", tx.ticker_fields(F.col("ticker")).alias("f"), "n").select("ticker", "f.*", "n").na.fill("-")


@query(f""", p AS (SELECT market_id % 32 AS bits, ({_PLACES})[wallet % 8 + 1] AS a, ({_PLACES})[wallet // 8 % 8 + 1] AS b, ({list(_STATES.values())})[wallet // 3 % 8 + 1] AS c, market_id % 20 + 1 AS seat FROM markets),
s AS (SELECT {list(_STATES.values())} AS names, {_PLACES} AS codes)
SELECT bits, CASE WHEN bits & 1 > 0 THEN 'Field ' || a WHEN bits & 2 > 0 THEN b WHEN bits & 4 > 0 THEN codes[list_position(names, c)] WHEN bits & 8 > 0 THEN a || '-' || seat WHEN bits & 16 > 0 THEN 'US' ELSE 'none' END AS place, count(*) AS n FROM p, s GROUP BY ALL""")
def composed_locations(spark, sf):
    """Every combination of own field, ticker, slug, question and default; the SQL takes the first that is there from the parts."""
    of = lambda values, by: F.get(F.array(*map(F.lit, values)), (by).cast("int"))
    k, w = F.col("market_id"), F.col("wallet")
    bit = lambda b, value: F.when((k % 32).bitwiseAND(F.lit(b)) > 0, value)
    cells = [
        bit(1, F.concat(F.lit(" Field "), of(_PLACES, w % 8), F.lit(" "))), bit(2, F.concat(F.lit("SENATE"), of(_PLACES, F.floor(w / 8) % 8), F.lit("-28-R"))),
        bit(4, F.concat(F.lit("who-wins-"), F.replace(of(list(_STATES.values()), F.floor(w / 3) % 8), F.lit(" "), F.lit("-")), F.lit("-senate-race"))),
        bit(8, F.concat(F.lit("Will "), of(_PLACES, w % 8), F.lit("-"), (k % 20 + 1).cast("string"), F.lit(" flip?"))), bit(16, F.lit("US")),
    ]
    m = markets(spark, sf).groupBy((k % 32).cast("int").alias("bits"), *[c.alias(f"c{i}") for i, c in enumerate(cells)]).agg(F.count("*").alias("n"))  # the chain once a distinct case
    place = F.coalesce(tx.location_chain(*[F.col(f"c{i}") for i in range(5)]), F.lit("none"))
    return m.select("bits", place.alias("place"), "n").groupBy("bits", "place").agg(F.sum("n").alias("n"))


_NAMED = {"Ohio": "OH", "Pennsylvania": "PA", "Texas": "TX", "Wisconsin": "WI", "Arizona": "AZ", "Michigan": "MI", "Nevada": "NV", "Florida": "FL"}
_PEOPLE = ["Jane Smith", "Robert Miller", "Ann Lee Jones", "Tom O'Brien"]


@query(f""", p AS (SELECT market_id % 4 AS kind, ({list(_NAMED)})[wallet % 8 + 1] AS state, ({list(_NAMED.values())})[wallet % 8 + 1] AS code, 2025 + market_id % 6 AS year, wallet // 8 % 2 = 0 AS dem, {str(_PEOPLE).replace('"Tom O' + chr(39) + 'Brien"', "'Tom O''Brien'")}[wallet // 8 % 4 + 1] AS person, 1 + wallet % 90 / 10.0 AS x FROM markets),
t AS (SELECT CASE kind WHEN 0 THEN 'Will a ' || CASE WHEN dem THEN 'Democrat' ELSE 'Republican' END || ' win the ' || state || ' Senate election in ' || year || '?' WHEN 1 THEN 'Will ' || person || ' win the ' || state || ' governor election in ' || year || '?'
  WHEN 2 THEN 'Will inflation reach ' || floor(x) || '.' || CAST(round(x * 10) AS INTEGER) % 10 || '% in ' || year || '?' ELSE 'Will unemployment fall below ' || CAST(floor(x) AS INTEGER) || '% in ' || year || '?' END AS question,
  CASE WHEN kind < 2 THEN 'contest' ELSE 'threshold' END AS frame_type, CASE WHEN kind = 1 THEN person ELSE '-' END AS candidate, CASE WHEN kind = 0 THEN CASE WHEN dem THEN 'DEM' ELSE 'GOP' END ELSE '-' END AS party, CASE kind WHEN 0 THEN 'SEN' WHEN 1 THEN 'GOV' ELSE '-' END AS office,
  CASE WHEN kind < 2 THEN 'US' ELSE '-' END AS country, CASE WHEN kind < 2 THEN code ELSE '-' END AS scope, CASE WHEN kind < 2 THEN 'state' ELSE '-' END AS scope_type, year, CASE kind WHEN 2 THEN 'INFLATION' WHEN 3 THEN 'UNEMPLOYMENT' ELSE '-' END AS metric,
  CASE kind WHEN 2 THEN round(x, 1) WHEN 3 THEN floor(x) ELSE -1 END AS threshold_value, CASE kind WHEN 2 THEN 'above' WHEN 3 THEN 'below' ELSE '-' END AS threshold_direction FROM p)
SELECT *, count(*) AS n FROM t GROUP BY ALL""".replace("floor(x) || '.'", "CAST(floor(x) AS INTEGER) || '.'"))
def composed_questions(spark, sf):
    """Questions put together from the rows; the SQL knows what they say, the query reads it back from the text."""
    of = lambda values, by: F.get(F.array(*map(F.lit, values)), by.cast("int"))
    k, w = F.col("market_id"), F.col("wallet")
    state, year, tenths = of(list(_NAMED), w % 8), (2025 + k % 6).cast("string"), (10 + w % 90).cast("long")
    end = F.concat(F.lit(" in "), year, F.lit("?"))
    text = (
        F.when(k % 4 == 0, F.concat(F.lit("Will a "), F.when(F.floor(w / 8) % 2 == 0, "Democrat").otherwise("Republican"), F.lit(" win the "), state, F.lit(" Senate election"), end))
        .when(k % 4 == 1, F.concat(F.lit("Will "), of(_PEOPLE, F.floor(w / 8) % 4), F.lit(" win the "), state, F.lit(" governor election"), end))
        .when(k % 4 == 2, F.concat(F.lit("Will inflation reach "), F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%"), end))
        .otherwise(F.concat(F.lit("Will unemployment fall below "), F.floor(tenths / 10).cast("string"), F.lit("%"), end))
    )
    q = written(markets(spark, sf).groupBy(text.alias("question")).agg(F.count("*").alias("n")))
    f = frames.extract(q.select("question")).select("question", *[f"frame.{c}" for c in ("frame_type", "candidate", "party", "office", "country", "scope", "scope_type", "year", "metric", "threshold_value", "threshold_direction")])
    return f.join(q, "question").na.fill("-").na.fill(-1)
