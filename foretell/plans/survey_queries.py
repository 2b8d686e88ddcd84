"""Queries on sources and sinks, predicates, hints, samples, rules and scores, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretell.functions import text as tx
from foretell.functions.numbers import corr
from foretell.operators import asof, binning, book, elections, frames, geo, pricing, quality, scoring, search, stats
from foretell.plans.domain_queries import _BOOK, _QUESTIONS, books, questions
from foretell.plans.market_queries import day_one, predictions, rounded, t_tail
from foretell.plans.registry import registry
from foretell.plans.views import DAY, PRELUDE, markets, table, ticks
from foretell.sources import readers, sinks
from foretell.sources.shared import shared_dir
from foretell.streaming import live

query, QUERIES, SQL = registry(PRELUDE)


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/q-{uuid.uuid4().hex}"


def _pick(values: list, by: str = "market_id"):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(by) % len(values) + 1).cast("int"))


def _list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + str(v).replace("'", "''") + "'" for v in values) + "]"


# Sources and sinks: what a sink wrote is read back by a source.


@query("SELECT market_id || '-x' AS id, platform, volume_usd FROM markets")
def csv_scan(spark, sf):
    """Ids stay text; only the columns asked for are read."""
    at = _folder(spark)
    sinks.overwrite(markets(spark, sf).select(F.concat(F.col("market_id").cast("string"), F.lit("-x")).alias("id"), "category", "platform", "volume_usd"), at, "csv")
    return readers.csv(spark, at, "id string, category string, platform string, volume_usd double", ["id", "platform", "volume_usd"])


@query("SELECT CAST(market_id AS VARCHAR) AS token_id, ts, price FROM ticks")
def series_map_scan(spark, sf):
    """A map of series a line: {id: [{t, p}, ...]}."""
    at = _folder(spark)
    t = ticks(spark, sf).groupBy("market_id").agg(F.collect_list(F.struct(F.col("ts").alias("t"), F.col("price").alias("p"))).alias("s"))
    t.select(F.to_json(F.create_map(F.col("market_id").cast("string"), F.col("s"))).alias("value")).write.text(at)
    return readers.series_map(spark, at, lines=True)


@query("SELECT market_id, volume_usd FROM markets WHERE market_id % 3 = 0")
def newest_file(spark, sf):
    """Of several files of a pattern the one written last."""
    at, m = _folder(spark), markets(spark, sf).select("market_id", "volume_usd")
    for k in (1, 0):
        sinks.overwrite(m.filter(F.col("market_id") % 3 == k), f"{at}/part-{k}")
        _touch(spark, f"{at}/part-{k}", 1_000_000_000_000 + (1 - k) * 60_000)
    return spark.read.parquet(readers.newest(spark, f"{at}/part-*"))


def _touch(spark, path: str, ms: int) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).setTimes(path, ms, -1)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate <= TIMESTAMP '1995-06-17 00:00:00'", prelude="")
def cutoff_scan(spark, sf):
    return readers.until(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "1995-06-17 00:00:00")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer", prelude="")
def paged_scan(spark, sf):
    """All pages of a listing, to the last."""
    at = _folder(spark)
    c = table(spark, sf, "customer").select(F.floor(F.col("c_custkey") / 40).alias("n"), F.struct(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name")).alias("item"))
    last = c.agg(F.max("n").alias("last"))
    pages = c.groupBy("n").agg(F.collect_list("item").alias("items")).crossJoin(F.broadcast(last))
    pages = pages.select(F.to_json(F.struct("items", (F.col("n") < F.col("last")).alias("next"))).alias("value"), F.col("n").alias("page"))
    pages.repartition("page").write.partitionBy("page").text(at)  # the fixture: a folder a page
    got = readers.paged(spark, at)
    return got.select("id", F.get_json_object("payload", "$.name").alias("name"))


@query(", r AS (SELECT category, count(*) AS n FROM markets GROUP BY 1) SELECT category || ' & ' || n || ' & ' || '1.5000' || ' \\\\' AS row FROM r")
def latex_table(spark, sf):
    r = markets(spark, sf).groupBy("category").agg(F.count("*").alias("n")).withColumn("x", F.lit(1.5))
    return sinks.latex_rows(r, ["category", "n", "x"])


@query("SELECT v AS version, c_custkey, c_name FROM customer, (VALUES ('003', 3), ('004', 4)) t(v, k) WHERE c_custkey % 5 <= k", prelude="")
def rotated_versions(spark, sf):
    """After five versions, each with more rows, of which two are kept: what is in the versions that are there."""
    at, c = _folder(spark), table(spark, sf, "customer").select("c_custkey", "c_name")
    for n in range(5):
        sinks.save_version(c.filter(F.col("c_custkey") % 5 <= n), at, f"{n:03d}", keep=2)
    return spark.read.schema("c_custkey bigint, c_name string, version string").parquet(at).select("version", "c_custkey", "c_name")


@query("SELECT market_id, ts, price FROM ticks")
def sorted_series(spark, sf):
    at = _folder(spark)
    sinks.sorted_export(ticks(spark, sf).select("market_id", "ts", "price"), at, "market_id", "ts")
    return spark.read.parquet(at)


# Predicates, names and hints.

_CATEGORIES = ["1. ELECTORAL", "1.2 Governor", "2. CONGRESS", "electoral reform", None, "10. Other"]
_RESULTS = ["Yes", "No", "yes", "no", "YES", "", None]
_PARTIES = ["R", "gop", "Republicans", " dem ", "Democratic", "d", "Green", None]
_HINTED = [
    "Will Republicans win NE-02?", "Who wins Maine's 1st congressional district in 2026?", "Will Ohio or Iowa flip in 2024?", "Will West Virginia vote blue in 2025 or 2024?", "Will it rain?", "Will XX-3 flip?", "Texas Senate 2026", "Will NJ-7 and Virginia go red?",
]


@query(f", c AS (SELECT ({_list(_CATEGORIES)})[market_id % {len(_CATEGORIES)} + 1] AS c FROM markets) SELECT coalesce(c, 'none') AS name, coalesce(starts_with(c, '1.') OR contains(upper(c), 'ELECTORAL'), false) AS electoral, count(*) AS n FROM c GROUP BY 1, 2")
def electoral_markets(spark, sf):
    c = markets(spark, sf).select(_pick(_CATEGORIES).alias("c"))
    return c.groupBy(F.coalesce("c", F.lit("none")).alias("name"), tx.is_electoral(F.col("c")).alias("electoral")).agg(F.count("*").alias("n"))


@query(f", c AS (SELECT platform, ({_list(_RESULTS)})[market_id % {len(_RESULTS)} + 1] AS r FROM markets) SELECT platform, coalesce(r, 'none') AS result, CASE WHEN r = 'Yes' OR (platform = 'kalshi' AND r = 'yes') THEN 1 WHEN r = 'No' OR (platform = 'kalshi' AND r = 'no') THEN 0 ELSE -1 END AS outcome, count(*) AS n FROM c GROUP BY ALL")
def resolved_markets(spark, sf):
    c = markets(spark, sf).select("platform", _pick(_RESULTS).alias("r"))
    return c.groupBy("platform", F.coalesce("r", F.lit("none")).alias("result"), F.coalesce(tx.resolved(F.col("platform"), F.col("r")), F.lit(-1)).alias("outcome")).agg(F.count("*").alias("n"))


@query(f", c AS (SELECT ({_list(_PARTIES)})[market_id % {len(_PARTIES)} + 1] AS p FROM markets) SELECT coalesce(p, 'none') AS given, coalesce(CASE WHEN lower(trim(p)) IN ('r', 'rep', 'gop', 'republican', 'republicans') THEN 'Republican' WHEN lower(trim(p)) IN ('d', 'dem', 'democrat', 'democratic', 'democrats') THEN 'Democrat' ELSE p END, 'none') AS party, count(*) AS n FROM c GROUP BY 1, 2")
def party_names(spark, sf):
    c = markets(spark, sf).select(_pick(_PARTIES).alias("p"))
    return c.groupBy(F.coalesce("p", F.lit("none")).alias("given"), F.coalesce(tx.normal_party(F.col("p")), F.lit("none")).alias("party")).agg(F.count("*").alias("n"))


@query("SELECT market_id, round(CASE WHEN outcome = 1 THEN p ELSE 1 - p END, 6) AS republican FROM predictions WHERE days = 7")
def republican_probabilities(spark, sf):
    p = predictions(spark, sf).filter("days = 7")
    return rounded(p.select("market_id", elections.republican_probability(F.col("p"), F.col("outcome") == 1).alias("republican")), "republican")


@query(_QUESTIONS + ", s AS (SELECT market_id, CASE WHEN market_id % 9 = 0 THEN '' WHEN market_id % 10 = 0 THEN NULL ELSE 'm-' || market_id END AS slug FROM q) SELECT market_id, coalesce(CASE WHEN slug <> '' THEN 'https://example.org/market/' || slug END, 'none') AS url FROM s")
def market_urls(spark, sf):
    s = markets(spark, sf).withColumn("slug", F.when(F.col("market_id") % 9 == 0, "").when(F.col("market_id") % 10 != 0, F.concat(F.lit("m-"), F.col("market_id").cast("string"))))
    return s.select("market_id", F.coalesce(tx.url("https://example.org/market/", F.col("slug")), F.lit("none")).alias("url"))


@query("SELECT c_custkey AS id, left(c_comment || c_comment || c_comment || c_comment, 200) AS notes FROM customer WHERE NOT (c_custkey % 5 - 2 = 0 AND c_nationkey % 3 - 1 = 0)".replace("c_comment", "c_name"), prelude="")
def clean_conflicts(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 5 - 2).alias("lat"), (F.col("c_nationkey") % 3 - 1).alias("lng"), F.concat(*[F.col("c_name")] * 4).alias("notes"), F.col("c_custkey").alias("date"))
    return geo.clean_events(c, "notes").select("id", "notes")


_STATES = ", ".join(f"('{n}', '{c}')" for n, c in tx.STATE_NAMES.items())


@query(f""", h AS (SELECT ({_list(_HINTED)})[market_id % {len(_HINTED)} + 1] AS question, year(to_timestamp(close_ts) AT TIME ZONE 'UTC') + 28 AS y, month(to_timestamp(close_ts) AT TIME ZONE 'UTC') AS m FROM markets),
states(name, code) AS (VALUES {_STATES}),
d AS (SELECT DISTINCT question FROM h),
p AS (SELECT question, regexp_extract(question, '\\b([A-Z]{{2}})-(\\d{{1,2}})\\b', 1) AS code, regexp_extract(question, '\\b([A-Z]{{2}})-(\\d{{1,2}})\\b', 2) AS num, regexp_extract(question, '(\\w+)''s (\\d+)(?:st|nd|rd|th) congressional', 1) AS cname, regexp_extract(question, '(\\w+)''s (\\d+)(?:st|nd|rd|th) congressional', 2) AS cnum, (SELECT list_sort(list(name)) FROM states WHERE regexp_matches(question, '\\b' || name || '\\b')) AS named FROM d),
l AS (SELECT question, CASE WHEN code IN (SELECT code FROM states) THEN (SELECT name FROM states s WHERE s.code = p.code) WHEN cname <> '' THEN cname ELSE named[1] END AS state, CASE WHEN code IN (SELECT code FROM states) THEN code || '-' || CAST(num AS INTEGER) WHEN cname <> '' THEN (SELECT s.code FROM states s WHERE name = cname) || '-' || cnum END AS district, CASE WHEN code IN (SELECT code FROM states) OR cname <> '' OR len(named) = 1 THEN 'high' WHEN len(named) > 1 THEN 'low' END AS sure FROM p),
z AS (SELECT h.*, list_transform(regexp_extract_all(question, '\\b(202\\d)\\b', 1), lambda x: CAST(x AS INTEGER)) AS ys FROM h)
SELECT question, coalesce(state, 'none') AS state, coalesce(district, 'none') AS district, coalesce(sure, 'none') AS location_confidence, CAST(coalesce(CASE WHEN len(ys) > 0 THEN list_min(ys) WHEN y BETWEEN 2020 AND 2030 THEN y - CASE WHEN m <= 3 THEN 1 ELSE 0 END END, -1) AS INTEGER) AS year, coalesce(CASE WHEN len(ys) = 1 THEN 'high' WHEN len(ys) > 1 THEN 'low' WHEN y BETWEEN 2020 AND 2030 THEN 'medium' END, 'none') AS year_confidence, count(*) AS n FROM z JOIN l USING (question) GROUP BY ALL""")
def question_hints(spark, sf):
    closed = F.expr("timestampadd(SECOND, close_ts, TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    h = markets(spark, sf).select(_pick(_HINTED).alias("question"), (F.year(closed) + 28).alias("y"), F.month(closed).alias("m"))
    h = h.groupBy("question", "y", "m").count()
    h = h.select("question", tx.location_hint(F.col("question")).alias("l"), tx.year_hint(F.col("question"), F.col("y"), F.col("m")).alias("t"), "count")
    none = lambda c: F.coalesce(c, F.lit("none"))
    keys = [none("l.state").alias("state"), none("l.district").alias("district"), none("l.confidence").alias("location_confidence"), F.coalesce("t.year", F.lit(-1)).alias("year"), none("t.confidence").alias("year_confidence")]
    return h.groupBy("question", *keys).agg(F.sum("count").alias("n"))


# Cases of the location chain, as own field, ticker, slug, question, default.
_CHAIN = [("Ohio ", None, None, None, None), ("", "SENATEMD-28-R", "senate-race-in-ohio", "Will it be?", "US"), (None, "KXFED-25NOV05", "senate-race-in-ohio", "PA-10?", "US"), (None, None, "some-race", "Will PA-10 flip?", "US"), (None, None, None, "Will it rain?", "US"), (None, None, None, "Will it rain?", None)]


@query(", c(k, place) AS (VALUES (0, 'Ohio'), (1, 'MD'), (2, 'OH'), (3, 'PA-10'), (4, 'US'), (5, 'none')) SELECT c.k AS k, place, count(*) AS n FROM markets m JOIN c ON m.market_id % 6 = c.k GROUP BY 1, 2")
def location_chain(spark, sf):
    cells = [_pick([row[i] for row in _CHAIN], "k").cast("string") for i in range(5)]
    m = markets(spark, sf).groupBy((F.col("market_id") % 6).cast("int").alias("k")).agg(F.count("*").alias("n"))  # the chain once a distinct case
    return m.select("k", F.coalesce(tx.location_chain(*cells), F.lit("none")).alias("place"), "n")


# Samples.

_SEEDED = "md5('42:' || market_id)"


@query(f"SELECT * FROM markets ORDER BY {_SEEDED}, market_id LIMIT 2000")
def sampled_markets(spark, sf):
    return search.sample(markets(spark, sf), "market_id", 2000)


@query(f"SELECT * FROM markets QUALIFY row_number() OVER (PARTITION BY category ORDER BY {_SEEDED}, market_id) <= 50")
def stratified_markets(spark, sf):
    return search.stratified(markets(spark, sf), "category", "market_id", 50)


@query("SELECT wallet, CAST('0x' || left(md5('42:' || wallet), 7) AS BIGINT) % 1000 < 800 AS train, count(*) AS n FROM markets GROUP BY 1, 2")
def train_split(spark, sf):
    return search.split(markets(spark, sf), "wallet").groupBy("wallet", "train").agg(F.count("*").alias("n"))


# Books.


def _venue_sides(spark, sf) -> DataFrame:
    l = ticks(spark, sf).select((F.col("market_id") % 500).alias("market_id"), (F.col("side") == "F").alias("yes"), F.round(F.col("price") * 60).cast("int").alias("cents"), F.col("size").cast("int").alias("size"))
    return l.groupBy("market_id", "yes", "cents").agg(F.sum("size").cast("int").alias("size"))


_CENTS = ", x AS (SELECT market_id % 500 AS market_id, side = 'F' AS yes, CAST(round(price * 60) AS INTEGER) AS cents, CAST(size AS INTEGER) AS size FROM ticks), v AS (SELECT market_id, yes, cents, sum(size) AS size FROM x GROUP BY 1, 2, 3)"


@query(_CENTS + " SELECT market_id, coalesce(max(cents / 100.0) FILTER (WHERE yes AND cents > 0), -1) AS best_bid, coalesce(round(min(1 - cents / 100.0) FILTER (WHERE NOT yes AND cents < 100), 6), -1) AS best_ask, CAST(coalesce(sum(size) FILTER (WHERE yes AND cents > 0), 0) AS DOUBLE) AS bid_depth FROM v GROUP BY 1")
def venue_books_in_cents(spark, sf):
    v = _venue_sides(spark, sf)
    side = lambda k: F.collect_list(F.when(k, F.array("cents", "size")))
    b = v.groupBy("market_id").agg(side(F.col("yes")).alias("y"), side(~F.col("yes")).alias("n"))
    bids, asks = book.from_cents(F.col("y"), F.col("n"))
    out = book.metrics(b.select("market_id", bids.alias("bids"), asks.alias("asks")))
    return out.select("market_id", F.coalesce("best_bid", F.lit(-1.0)).alias("best_bid"), F.coalesce(F.round("best_ask", 6), F.lit(-1.0)).alias("best_ask"), "bid_depth")


@query(_CENTS + " SELECT market_id, coalesce(max(cents / 100.0) FILTER (WHERE yes AND cents > 0 AND cents % 7 <> 0), -1) AS best_bid, CAST(coalesce(sum(size) FILTER (WHERE yes AND cents > 0 AND cents % 7 <> 0), 0) AS DOUBLE) AS bid_depth FROM v GROUP BY 1")
def venue_books_in_text(spark, sf):
    """Prices and sizes are text under one of two names; what is not a number is dropped."""
    v = _venue_sides(spark, sf).filter("yes OR NOT yes")
    number = F.when(F.col("cents") % 7 == 0, "n/a").otherwise((F.col("cents") / 100).cast("string"))
    odd = F.col("cents") % 2 == 1
    level = F.struct(F.when(odd, number).alias("price"), F.when(~odd, number).alias("p"), F.when(odd, F.col("size").cast("string")).alias("size"), F.when(~odd, F.col("size").cast("string")).alias("s"))
    b = v.groupBy("market_id").agg(F.collect_list(F.when(F.col("yes"), level)).alias("l")).select("market_id", book.from_strings(F.col("l"), True).alias("bids"), F.expr("cast(array() as array<struct<price:double,size:double>>)").alias("asks"))
    return book.metrics(b).select("market_id", F.coalesce("best_bid", F.lit(-1.0)).alias("best_bid"), "bid_depth")


@query(_BOOK + ", g AS (SELECT market_id, CAST(up AS DOUBLE) AS a, CAST(down AS DOUBLE) AS b FROM c) SELECT market_id, coalesce(least(a, b), -1) AS cost, coalesce(CASE WHEN a IS NULL AND b IS NULL THEN NULL WHEN b IS NULL OR a <= b THEN 'polymarket' ELSE 'kalshi' END, 'none') AS venue FROM g")
def weakest_venues(spark, sf):
    """The cost of moving the price up stands for one venue's, down for the other's."""
    g = books(spark, sf).select("market_id", book.weakest(book._walk(F.col("asks"), 1).cast("double"), book._walk(F.col("bids"), -1).cast("double")).alias("w"))
    return g.select("market_id", F.coalesce("w.cost", F.lit(-1.0)).alias("cost"), F.coalesce("w.venue", F.lit("none")).alias("venue"))


# Rules.


@query("""SELECT 'market_id' AS "column", true AS present, count(market_id) AS filled, round(1 - count(market_id) / count(*), 6) AS gap FROM markets UNION ALL SELECT 'outcome', true, count(outcome), round(1 - count(outcome) / count(*), 6) FROM markets
UNION ALL SELECT 'slug', false, 0, 1.0 UNION ALL SELECT 'party', true, count(*) FILTER (WHERE wallet % 3 = 0), round(1 - count(*) FILTER (WHERE wallet % 3 = 0) / count(*), 6) FROM markets UNION ALL SELECT 'ticker', false, 0, 1.0""")
def missing_columns(spark, sf):
    m = markets(spark, sf).withColumn("party", F.when(F.col("wallet") % 3 == 0, "R"))
    return rounded(quality.required_columns(m, ["market_id", "outcome", "slug", "party", "ticker"]), "gap")


@query(", i AS (SELECT 'volume' AS rule, 'WARNING' AS level, count(*) FILTER (WHERE volume_usd > 300000) AS n FROM markets UNION ALL SELECT 'outcome', 'ERROR', count(*) FILTER (WHERE outcome IS NULL) FROM markets UNION ALL SELECT 'platform', 'CRITICAL', 0) SELECT count(*) FILTER (WHERE level = 'INFO') AS info, count(*) FILTER (WHERE level = 'WARNING') AS warning, count(*) FILTER (WHERE level = 'ERROR') AS error, count(*) FILTER (WHERE level = 'CRITICAL') AS critical, 'ERROR' AS status FROM i WHERE n > 0")
def severity_report(spark, sf):
    m = markets(spark, sf)
    n = m.agg(F.count_if(F.col("volume_usd") > 300000).alias("a"), F.count_if(F.col("outcome").isNull()).alias("b"))
    issues = n.select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(s).alias("level"), c.alias("n")) for r, s, c in (("volume", "WARNING", F.col("a")), ("outcome", "ERROR", F.col("b")), ("platform", "CRITICAL", F.lit(0).cast("long")))])))
    return quality.report(issues)


@query("SELECT count(*) AS closed, count(*) FILTER (WHERE outcome IS NULL) AS missing, round(1 - count(*) FILTER (WHERE outcome IS NULL) / count(*), 6) AS rate, 1 - count(*) FILTER (WHERE outcome IS NULL) / count(*) < 0.7 AS too_low FROM markets WHERE close_ts < 883612800")
def resolution_rate(spark, sf):
    return rounded(quality.resolution_rate(markets(spark, sf), F.col("close_ts") < 883612800, "outcome"), "rate")


@query("SELECT close_ts // 86400 AS day, count(*) AS n FROM markets GROUP BY 1 HAVING count(*) > (SELECT count(*) / 2000 FROM markets)")
def market_spikes(spark, sf):
    m = markets(spark, sf)
    return quality.spikes(m, F.floor(F.col("close_ts") / DAY), m.count() // 2000)


@query("SELECT count(*) AS calls, count(*) FILTER (WHERE size > 45) AS errors, round(count(*) FILTER (WHERE size > 45) / count(*), 6) AS rate, count(*) FILTER (WHERE size > 45) / count(*) > 0.1 AS too_high FROM ticks")
def failure_rate(spark, sf):
    return rounded(quality.failure_rate(ticks(spark, sf), F.col("size") > 45), "rate")


@query("SELECT count(*) AS n, round((avg(CASE WHEN outcome IS NULL THEN 1.0 ELSE 0.0 END) + avg(CASE WHEN market_id % 4 = 0 THEN 1.0 ELSE 0.0 END)) / 2, 6) AS gap, (avg(CASE WHEN outcome IS NULL THEN 1.0 ELSE 0.0 END) + avg(CASE WHEN market_id % 4 = 0 THEN 1.0 ELSE 0.0 END)) / 2 > 0.15 AS too_high FROM markets")
def metadata_gap(spark, sf):
    m = markets(spark, sf).withColumn("year", F.when(F.col("market_id") % 4 != 0, F.lit(2024)))
    return rounded(quality.metadata_gap(m, ["outcome", "year"]), "gap")


# Scores and views.


@query(_BOOK + ", k AS (SELECT market_id, CAST(least(up, down) AS BIGINT) AS cost FROM c WHERE least(up, down) IS NOT NULL) SELECT m.market_id, m.platform, k.cost FROM markets m JOIN k USING (market_id) ORDER BY cost DESC, market_id")
def reportable_markets(spark, sf):
    costs = books(spark, sf).select("market_id", book.cost_to_move(F.col("bids"), F.col("asks")).cast("long").alias("cost")).filter(F.col("cost").isNotNull())
    return search.reportable(markets(spark, sf).select("market_id", "platform"), costs, "market_id", "cost")


@query(", d AS (SELECT market_id, category, p, volume_usd FROM predictions WHERE days = 1), r AS (SELECT market_id, category, (rank() OVER (PARTITION BY category ORDER BY p) + (count(*) OVER (PARTITION BY category, p) - 1) / 2.0) / count(*) OVER (PARTITION BY category) AS s, (rank() OVER (PARTITION BY category ORDER BY volume_usd) + (count(*) OVER (PARTITION BY category, volume_usd) - 1) / 2.0) / count(*) OVER (PARTITION BY category) AS v FROM d) SELECT market_id, category, round(0.3 * (1 - s) + 0.7 * v, 6) AS liquidity_score FROM r")
def liquidity_scores(spark, sf):
    d = stats.liquidity_score(day_one(spark, sf).select("market_id", "category", "p", "volume_usd"), "category", "p", "volume_usd", (0.3, 0.7))
    return rounded(d, "liquidity_score").select("market_id", "category", "liquidity_score")


@query("SELECT market_id, max(ts) AS at FROM ticks GROUP BY 1 HAVING max(ts) >= (SELECT max(ts) FROM ticks) - 5184000")
def unexpired_prices(spark, sf):
    t = ticks(spark, sf)
    now = t.agg(F.max("ts")).first()[0] or 0
    serving = live.upsert(t.filter("flag = 'A'").groupBy("market_id").agg(F.max("ts").alias("at")), t.filter("flag <> 'A'").groupBy("market_id").agg(F.max("ts").alias("at")), "market_id", "at")
    return live.unexpired(serving, "at", now, 60 * DAY)


@query(", v AS (SELECT wallet, sum(volume_usd) AS v FROM markets GROUP BY 1), r AS (SELECT v, row_number() OVER (ORDER BY v DESC, wallet) AS rank, count(*) OVER () AS n FROM v), p AS (SELECT CAST(ceil(rank * 20 / n) AS INTEGER) AS part, count(*) AS keys, sum(v) AS v FROM r GROUP BY 1) SELECT part, CAST(sum(keys) OVER (ORDER BY part) AS BIGINT) AS keys, round(sum(v) OVER (ORDER BY part) / sum(v) OVER (), 6) AS share FROM p")
def volume_curve(spark, sf):
    return rounded(scoring.share_curve(markets(spark, sf), "wallet", "volume_usd", 20), "share")


@query(", b AS (SELECT range AS bin FROM range(12)), h AS (SELECT CAST(least(floor((least(greatest(log10(volume_usd), 3), 6) - 3) / 0.25), 11) AS BIGINT) AS bin, count(*) AS n FROM markets WHERE volume_usd > 0 GROUP BY 1) SELECT CAST(b.bin AS INTEGER) AS bin, round(pow(10, 3 + b.bin * 0.25), 4) AS \"from\", round(pow(10, 3 + (b.bin + 1) * 0.25), 4) AS \"to\", coalesce(n, 0) AS n FROM b LEFT JOIN h USING (bin)")
def volume_histogram(spark, sf):
    """Bins of equal width in the logarithm."""
    return rounded(binning.log_histogram(markets(spark, sf), "volume_usd", 12, 1e3, 1e6), "from", "to", places=4)


@query("SELECT market_id, CAST(wallet AS VARCHAR) AS slug FROM markets WHERE market_id % 3 <> 0 AND wallet % 7 <> 0")
def new_by_two_ids(spark, sf):
    """Rows that neither of two ids is known of; a null id of the known side matches nothing."""
    m = markets(spark, sf).select("market_id", F.col("wallet").cast("string").alias("slug"))
    known = m.select(F.when(F.col("market_id") % 3 == 0, F.col("market_id")).alias("market_id"), F.when(F.col("slug").cast("long") % 7 == 0, F.col("slug")).alias("slug"))
    return quality.only_new(m, known, ["market_id", "slug"])


def _tiers_sql() -> str:
    pick = lambda f: "coalesce(" + ", ".join(f"CASE WHEN n{h} >= 10 THEN {f}{h} END" for h in (6, 12, 24)) + f", {f}24)"
    cells = ", ".join(f"count(*) FILTER (WHERE age <= {h * 3600}) AS n{h}, CASE WHEN sum(size) FILTER (WHERE age <= {h * 3600}) > 0 THEN floor(sum(price * size) FILTER (WHERE age <= {h * 3600}) / sum(size) FILTER (WHERE age <= {h * 3600}) * 10000 + 0.500001) / 10000 END AS v{h}" for h in (6, 12, 24))
    return f", m AS (SELECT category, max(ts) AS now FROM markets JOIN ticks USING (market_id) GROUP BY 1), t AS (SELECT category, platform, price, size, (now - ts) / 720 AS age FROM markets JOIN ticks USING (market_id) JOIN m USING (category)), w AS (SELECT category, {cells} FROM t WHERE age >= 0 AND age <= 86400 GROUP BY 1) SELECT category, {pick('v')} AS vwap, {pick('n')} AS trade_count, CASE WHEN n6 >= 10 THEN 1 WHEN n12 >= 10 OR n24 >= 10 THEN 2 ELSE 3 END AS tier FROM w"


@query(_tiers_sql())
def pooled_tiers(spark, sf):
    """The trades of both venues as one tape, averaged over the first window that has enough of them; a day of the tables counts as two minutes."""
    j = markets(spark, sf).select("market_id", "platform", "category").join(ticks(spark, sf), "market_id")
    tape = j.filter("platform = 'kalshi'").unionByName(j.filter("platform = 'polymarket'"))
    now = tape.groupBy("category").agg(F.max("ts").alias("now"))
    t = tape.join(F.broadcast(now), "category")
    return pricing.tiered_vwap(t, ["category"], (F.col("now") - F.col("ts")) / 720).select("category", "vwap", "trade_count", "tier")


@query(""", d AS (SELECT m.market_id, m.category, m.p, m.outcome, r.price AS resolution FROM predictions m JOIN (SELECT k.market_id, (array_agg(price ORDER BY ts DESC, ord DESC, price DESC))[1] AS price FROM markets k JOIN ticks t ON t.market_id = k.market_id AND t.ts <= k.close_ts GROUP BY 1) r USING (market_id) WHERE m.days = 7),
b AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY p, market_id) AS k, count(*) OVER (PARTITION BY category) AS n FROM d)
SELECT category, CAST(least((k - 1) // greatest(1, n // 20), 19) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(resolution), 6) AS mean_resolution, round(avg(outcome), 6) AS mean_outcome FROM b WHERE n >= 50 GROUP BY 1, 2""")
def paired_calibration(spark, sf):
    """Predictions a week before the close and prices at the close, over the same bins."""
    p = predictions(spark, sf).filter("days = 7")
    closing = asof.backward(markets(spark, sf).select("market_id", "close_ts"), ticks(spark, sf), "market_id", "close_ts", "ts", "price", ["ord", "price"], out="resolution").filter("resolution is not null")
    out = binning.paired_calibration(p.join(closing.select("market_id", "resolution"), "market_id"), "category", "p", "resolution", "outcome", "market_id")
    return rounded(out, "mean_p", "mean_resolution", "mean_outcome")


_FIRST_OF = "SELECT market_id, platform, slug FROM (SELECT market_id, platform, CASE WHEN wallet % 2 = 0 THEN 'M-' ELSE 'm-' END || market_id % 1000 AS slug, volume_usd FROM markets) WHERE lower(slug) = '{0}' ORDER BY volume_usd DESC, market_id LIMIT 1"


@query(", " + ", ".join(f"s{k} AS ({_FIRST_OF.format(f'm-{k}')})" for k in (1, 7, 990)) + " SELECT * FROM s1 UNION ALL SELECT * FROM s7 UNION ALL SELECT * FROM s990")
def market_by_slug(spark, sf):
    m = markets(spark, sf).withColumn("slug", F.concat(F.when(F.col("wallet") % 2 == 0, "M-").otherwise("m-"), (F.col("market_id") % 1000).cast("string")))
    found = [search.by_slug(m, "slug", f"M-{k}", [F.desc("volume_usd"), F.col("market_id")]).select("market_id", "platform", "slug") for k in (1, 7, 990)]
    return found[0].union(found[1]).union(found[2])


_EVENT_SQL = """, e AS (SELECT market_id, 'BWR-' || (['ELEC', 'POL'])[market_id % 2 + 1] || '-' || (['US', 'GB', 'FR'])[wallet % 3 + 1] || '-' || (['PRES', 'SEN'])[market_id % 5 % 2 + 1] || '-' || (2024 + wallet % 4) AS a,
  'BWR-' || (['ELEC', 'POL'])[wallet % 2 + 1] || '-' || (['US', 'GB', 'FR'])[wallet % 3 + 1] || '-' || (['PRES', 'SEN'])[wallet % 7 % 2 + 1] || '-' || (2024 + wallet % 4) || CASE WHEN market_id % 3 = 0 THEN '-PRI' ELSE '' END AS b FROM markets),
x AS (SELECT *, string_split(a, '-') AS p, string_split(regexp_replace(b, '-PRI$', ''), '-') AS q FROM e)"""


@query(_EVENT_SQL + " SELECT a, b, q[2] AS type, CASE WHEN q[2] = 'ELEC' THEN q[3] ELSE '-' END AS country, CAST(q[len(q)] AS INTEGER) AS year, b LIKE '%-PRI' AS is_primary, p[2] = q[2] AND p[len(p)] = q[len(q)] AND (p[2] <> 'ELEC' OR (p[3] = q[3] AND p[4] = q[4])) AS same, count(*) AS n FROM x GROUP BY ALL")
def compared_event_ids(spark, sf):
    of = lambda values, by: F.get(F.array(*map(F.lit, values)), (by % len(values)).cast("int"))
    k, w = F.col("market_id"), F.col("wallet")
    id_ = lambda kind, office, end: F.concat(F.lit("BWR-"), of(["ELEC", "POL"], kind), F.lit("-"), of(["US", "GB", "FR"], w), F.lit("-"), of(["PRES", "SEN"], office), F.lit("-"), (2024 + w % 4).cast("string"), end)
    e = markets(spark, sf).select(id_(k, k % 5, F.lit("")).alias("a"), id_(w, w % 7, F.when(k % 3 == 0, "-PRI").otherwise("")).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    parsed = frames.parse_id(F.col("b"))
    return e.select("a", "b", parsed.type.alias("type"), F.coalesce(parsed.country, F.lit("-")).alias("country"), parsed.year.alias("year"), parsed.is_primary.alias("is_primary"), frames.loosely_equal(F.col("a"), F.col("b")).alias("same"), "n")


#: The 97.5 % point of Student's t from that of the normal distribution, by its expansion in the degrees of freedom.
_REACH = "(1.959963984540054 + (pow({z}, 3) + {z}) / (4 * {f}) + (5 * pow({z}, 5) + 16 * pow({z}, 3) + 3 * {z}) / (96 * pow({f}, 2)) + (3 * pow({z}, 7) + 19 * pow({z}, 5) + 17 * pow({z}, 3) - 15 * {z}) / (384 * pow({f}, 3)))".replace("{z}", "1.959963984540054")
_FIT = """, d AS (SELECT market_id, platform, category, CAST(outcome AS DOUBLE) AS y, p AS x FROM predictions WHERE {where}),
m AS (SELECT count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx, regr_syy(y, x) - regr_slope(y, x) * regr_slope(y, x) * regr_sxx(y, x) AS rss, avg(x) AS mx, regr_r2(y, x) AS r2 FROM d)"""


def _terms(errors: str, freedom: str) -> str:
    """Rows of a fit with one regressor: coefficients, standard errors (columns se_a, se_b of `errors`), and what follows from them."""
    one = lambda name, coef, se: f"SELECT '{name}' AS term, {coef} AS coef, {se} AS se, {coef} / {se} AS t, {freedom} AS f, r2, n FROM m, {errors}"
    return f", z AS ({one('intercept', 'a', 'se_a')} UNION ALL {one('p', 'b', 'se_b')}) SELECT term, round(coef, 6) AS coef, round(se, 6) AS se, round(t, 4) AS t, round({t_tail('z.t', 'z.f')}, 5) AS p_value, round(coef - {_REACH.format(f='f')} * se, 5) AS low, round(coef + {_REACH.format(f='f')} * se, 5) AS high, round(r2, 6) AS r2, n FROM z"


def _fitted(out):
    return rounded(rounded(rounded(out, "coef", "se", "r2"), "t", places=4), "p_value", "low", "high", places=5)


@query(_FIT.format(where="days = 1") + ", s AS (SELECT sqrt(rss / (n - 2) * (1.0 / n + mx * mx / sxx)) AS se_a, sqrt(rss / (n - 2) / sxx) AS se_b FROM m)" + _terms("s", "n - 2"))
def least_squares_with_limits(spark, sf):
    return _fitted(stats.ols(day_one(spark, sf), "outcome", ["p"]))


@query(_FIT.format(where="true") + """, g AS (SELECT market_id, sum(y - a - b * x) AS u, sum((y - a - b * x) * x) AS v FROM d, m GROUP BY 1),
k AS (SELECT count(*) AS g, sum(u * u) AS uu, sum(u * v) AS uv, sum(v * v) AS vv FROM g),
i AS (SELECT (sxx + n * mx * mx) / (n * sxx) AS i11, -mx / sxx AS i12, 1 / sxx AS i22, n FROM m),
s AS (SELECT g, sqrt(g / (g - 1.0) * (n - 1.0) / (n - 2.0) * (i11 * i11 * uu + 2 * i11 * i12 * uv + i12 * i12 * vv)) AS se_a, sqrt(g / (g - 1.0) * (n - 1.0) / (n - 2.0) * (i12 * i12 * uu + 2 * i12 * i22 * uv + i22 * i22 * vv)) AS se_b FROM k, i)""" + _terms("s", "g - 1"))
def clustered_slope(spark, sf):
    """One regressor over all horizons, errors clustered by market."""
    return _fitted(stats.ols(predictions(spark, sf), "outcome", ["p"], cluster="market_id"))


@query(_BOOK + """, r AS (SELECT p.category, p.platform, (p.p - p.outcome) * (p.p - p.outcome) - p.p * (1 - p.p) AS rb, b.best_ask - b.best_bid AS spread, b.bid_depth + b.ask_depth AS depth FROM predictions p JOIN b ON p.market_id % 500 = b.market_id WHERE p.days = 1 AND b.n_bid > 0 AND b.n_ask > 0)
SELECT category, platform, count(*) AS n, round(corr(rb, spread), 5) AS with_spread, round(corr(rb, depth), 5) AS with_depth, round(avg(rb), 6) AS residual FROM r GROUP BY 1, 2 HAVING count(*) >= 3""")
def residual_by_book(spark, sf):
    """Residual Brier scores against spread and depth of the market's book, by category and venue with at least three markets."""
    b = book.metrics(books(spark, sf)).select(F.col("market_id").alias("g"), "spread", (F.col("bid_depth") + F.col("ask_depth")).alias("depth")).filter("spread is not null")
    d = day_one(spark, sf).withColumn("rb", stats.residual_brier(F.col("p"), F.col("outcome"))).withColumn("g", F.col("market_id") % 500)
    out = d.join(b, "g").groupBy("category", "platform").agg(F.count("*").alias("n"), corr("rb", "spread").alias("with_spread"), corr("rb", "depth").alias("with_depth"), F.avg("rb").alias("residual")).filter("n >= 3")
    return rounded(rounded(out, "with_spread", "with_depth", places=5), "residual")


@query(", m AS (SELECT category, CASE WHEN market_id % 4 > 0 THEN 'x' END AS country, CASE WHEN wallet % 5 > 0 THEN 'y' END AS office, outcome FROM markets) SELECT count(*) AS n, count(*) - count(country) AS missing_country, count(*) - count(office) AS missing_office, count(*) AS missing_year, round(1 - (3 * count(*) - count(country) - count(office)) / (3 * count(*)), 6) AS coverage, 0.85 AS threshold, 1 - (3 * count(*) - count(country) - count(office)) / (3 * count(*)) < 0.85 AS too_low FROM m WHERE starts_with(category, '1')")
def electoral_coverage(spark, sf):
    m = markets(spark, sf).withColumn("country", F.when(F.col("market_id") % 4 > 0, "x")).withColumn("office", F.when(F.col("wallet") % 5 > 0, "y"))
    return rounded(quality.covered(m, F.col("category").startswith("1"), ["country", "office", "year"]), "coverage")


@query(", e AS (SELECT wallet AS election, platform, p, market_id FROM predictions JOIN (SELECT market_id, wallet // 2 AS wallet FROM markets) USING (market_id) WHERE days = 1) SELECT election, count(*) FILTER (WHERE platform = 'polymarket') AS n_polymarket, round(avg(p) FILTER (WHERE platform = 'polymarket'), 6) AS prediction_polymarket, min(market_id) FILTER (WHERE platform = 'polymarket') AS first_polymarket, count(*) FILTER (WHERE platform = 'kalshi') AS n_kalshi, round(avg(p) FILTER (WHERE platform = 'kalshi'), 6) AS prediction_kalshi, min(market_id) FILTER (WHERE platform = 'kalshi') AS first_kalshi, CASE WHEN count(DISTINCT platform) = 2 THEN 'both' ELSE min(platform) END AS side FROM e GROUP BY 1")
def overlap_panel(spark, sf):
    e = day_one(spark, sf).join(markets(spark, sf).select("market_id", F.floor(F.col("wallet") / 2).alias("election")), "market_id")
    return rounded(quality.overlap(e, ["election"], "platform", "p", "market_id"), "prediction_polymarket", "prediction_kalshi")


@query(""", a AS (SELECT market_id, platform, volume_usd, CASE outcome WHEN 1 THEN 'YES' WHEN 0 THEN 'no' ELSE 'Other' END AS winning_outcome FROM markets WHERE market_id % 5 > 0),
b AS (SELECT market_id, 'new' AS platform, CASE WHEN market_id % 3 > 0 THEN CAST(floor(volume_usd) AS DOUBLE) END AS volume_usd, CASE outcome WHEN 1 THEN 'yes' ELSE 'NO' END AS winning_outcome FROM markets WHERE market_id % 5 = 0)
SELECT market_id, platform, volume_usd, CASE lower(winning_outcome) WHEN 'yes' THEN 'Yes' WHEN 'no' THEN 'No' ELSE winning_outcome END AS winning_outcome FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def aligned_merge(spark, sf):
    """New rows in other names, types and case, some known already, with a column that the master lacks."""
    m = markets(spark, sf)
    master = m.filter("market_id % 5 > 0").select("market_id", "platform", "volume_usd", F.when(F.col("outcome") == 1, "YES").when(F.col("outcome") == 0, "no").otherwise("Other").alias("winning_outcome"))
    amount = F.when(F.col("market_id") % 3 > 0, F.floor("volume_usd").cast("string")).otherwise("n/a")
    new = m.filter("market_id % 5 = 0 OR market_id % 7 = 0").select(F.col("market_id").alias("ID"), F.lit("new").alias("venue"), amount.alias("volume_usd"), F.when(F.col("outcome") == 1, "yes").otherwise("NO").alias("winning_outcome"), F.lit(1).alias("more"))
    return quality.merge_aligned(master, new, ["market_id"], {"ID": "market_id", "venue": "platform"}, "winning_outcome")
