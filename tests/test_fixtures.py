"""Literal cases with known values."""

import json

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foretell.functions import text as tx
from foretell.functions.numbers import seconds
from foretell.operators import asof, binning, book, elections, frames, matching, pricing, quality, ranks, scoring, stats, traders
from foretell.operators.matching import _similarity
from foretell.sources import readers, sinks
from foretell.streaming import live


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_scores(spark):
    rows = spark.createDataFrame([(0.9, 1, 0.01), (0.1, 0, 0.01), (0.9, 0, 0.81), (0.5, 1, 0.25), (0.5, 0, 0.25)], "p double, outcome int, b double")
    assert all(abs(r.x - r.b) < 1e-12 for r in rows.select("b", scoring.brier(F.col("p"), F.col("outcome")).alias("x")).collect())
    a, b = one(spark, scoring.log_loss(F.lit(0.9), F.lit(1)), scoring.log_loss(F.lit(0.0), F.lit(1)))
    assert a == pytest.approx(0.105360515657826) and b == pytest.approx(34.538776394910684)


@pytest.mark.parametrize("strategy", ["agg", "merge"])
def test_asof(spark, strategy):
    t = spark.createDataFrame([("a", 10, 0.1), ("a", 20, 0.2), ("a", 30, 0.3)], "k string, ts long, p double")
    at = spark.createDataFrame([("a", 25), ("a", 5), ("a", 20), ("b", 25)], "k string, at long")
    got = {(r.k, r.at): r.price for r in asof.backward(at, t, "k", "at", "ts", "p", [], strategy=strategy).collect()}
    assert got == {("a", 25): 0.2, ("a", 5): None, ("a", 20): 0.2, ("b", 25): None}


@settings(max_examples=15, deadline=None)
@given(ticks=st.lists(st.tuples(st.integers(0, 3), st.integers(0, 50), st.integers(0, 100)), max_size=30), cuts=st.sets(st.tuples(st.integers(0, 3), st.integers(0, 50)), min_size=1, max_size=10))
def test_asof_strategies_agree_and_never_look_ahead(spark, ticks, cuts):
    t = spark.createDataFrame([(k, ts, float(v), i) for i, (k, ts, v) in enumerate(ticks)], "k int, ts long, p double, i int")
    at = spark.createDataFrame(sorted(cuts), "k int, at long")
    want = {(k, c): next((float(v) for _, i, v in sorted(((ts, i, v) for i, (kk, ts, v) in enumerate(ticks) if kk == k and ts <= c), reverse=True)), None) for k, c in cuts}
    for s in ("agg", "merge"):
        assert {(r.k, r.at): r.price for r in asof.backward(at, t, "k", "at", "ts", "p", ["i"], strategy=s).collect()} == want


def test_window_means(spark):
    t = spark.createDataFrame([("m", 10, 0.1, 1), ("m", 20, 0.2, 2), ("m", 30, 0.3, 3)], "market_id string, ts long, price double, ord long")
    m = spark.createDataFrame([("m", 30), ("m", 45)], "market_id string, at long")
    got = {r.at: (r.w10, r.w5) for r in pricing.window_means(m, t, "at", {"w10": 10, "w5": 5}).collect()}
    assert got[30] == (pytest.approx(0.25), pytest.approx(0.3)) and got[45][1] == pytest.approx(0.3)


def test_prices(spark):
    n = F.lit(None).cast("int")
    c = pricing.candle_price
    assert one(spark, c(n, F.lit(40), n, n), c(n, n, F.lit(10), F.lit(20)), c(n, n, n, F.lit(20))) == (0.4, 0.15, 0.2)
    t = spark.createDataFrame([(0.5, 10.0), (0.6, 30.0)], "price double, size double")
    assert tuple(pricing.trade_vwap(t.withColumn("k", F.lit(1)), ["k"]).first())[1:] == (0.575, 2, 40)
    assert one(spark, seconds(F.lit(1700000000)), seconds(F.lit(1700000000123))) == (1700000000, 1700000000)


def levels(*pairs):
    return F.array(*[F.struct(F.lit(float(p)).alias("price"), F.lit(float(s)).alias("size")) for p, s in pairs]) if pairs else F.expr(f"cast(array() as {book.LEVELS})")


def test_books(spark):
    assert one(spark, book.cost_to_move(levels(), levels((0.5, 100), (0.52, 100), (0.56, 10))), book.cost_to_move(levels(), levels((0.5, 100)))) == (102, None)
    g = lambda cost, tier: book.grade(F.lit(cost).cast("double"), F.lit(tier))
    assert one(spark, g(9999, 1), g(10000, 1), g(100000, 1), g(100000, 2), g(100000, 3), g(None, 1)) == ("fragile", "caution", "robust", "caution", "fragile", "fragile")
    i = one(spark, book.price_impact(levels((0.5, 100), (0.6, 100)), F.lit(0.5), 80))[0]
    assert (i.impact_cents, i.shares, i.levels, i.spent) == (10, 150, 2, 80)
    bids, asks = one(spark, *book.from_cents(F.array(F.array(F.lit(40), F.lit(5)), F.array(F.lit(45), F.lit(2))), F.array(F.array(F.lit(50), F.lit(7)))))
    assert [tuple(x) for x in bids] == [(0.45, 2), (0.4, 5)] and [tuple(x) for x in asks] == [(0.5, 7)]
    s = book.from_strings(F.array(F.struct(F.lit("0.4").alias("price"), F.lit(None).cast("string").alias("p"), F.lit("3").alias("size"), F.lit(None).cast("string").alias("s")), F.struct(F.lit("x").alias("price"), F.lit(None).cast("string").alias("p"), F.lit("3").alias("size"), F.lit(None).cast("string").alias("s"))), True)
    assert [tuple(x) for x in one(spark, s)[0]] == [(0.4, 3)]
    w = one(spark, book.weakest(F.lit(None).cast("double"), F.lit(5.0)), book.weakest(F.lit(5.0), F.lit(5.0)))
    assert (w[0].cost, w[0].venue, w[1].venue) == (5, "kalshi", "polymarket")
    snap = spark.createDataFrame([(1, 30.0, 10.0), (1, 0.0, 0.0)], "k int, bid_depth double, ask_depth double").withColumns({"spread": F.lit(1.0), "relative_spread": F.lit(1.0), "midpoint": F.lit(0.5), "total_depth": F.lit(1.0)})
    assert book.liquidity(snap, ["k"]).first().imbalance_mean == 0.25


def test_ranks_and_bins(spark):
    x = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, 3.0), (5, None)], "id long, x double")
    assert [r.rank_pct for r in ranks.rank_pct(x, "x").orderBy("id").collect()] == [0.25, 0.625, 0.625, 1.0, None]
    seven = spark.range(7).withColumn("x", F.col("id") * 1.0)
    assert [r["count"] for r in binning.equal_count_bins(seven, "x", "id", 3).groupBy("bin").count().orderBy("bin").collect()] == [2, 2, 3]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([0.0, 0.5, 1.0]), st.floats(-5, 5)), min_size=2, max_size=60))
def test_bins_like_pandas(spark, xs):
    df = spark.createDataFrame(list(enumerate(map(float, xs))), "id long, x double")
    got = [r.rank for r in ranks.global_rank(df, "x", "id").orderBy("id").collect()]
    order = sorted(range(len(xs)), key=lambda i: (xs[i], i % ranks.SHARDS, i))
    assert [order[r - 1] for r in got] == list(range(len(xs)))
    s = pd.Series(xs)
    assert [r.rank for r in ranks.average_rank(df, "x").orderBy("id").collect()] == s.rank().tolist()
    assert binning.histogram(df, "x", 10, -5.0, 5.0).agg(F.sum("n")).first()[0] == len(xs)


def test_elections(spark):
    e = F.lit(None).cast("string")
    key = elections.election_key
    assert one(spark, key(F.lit("US"), F.lit("SEN"), e, F.lit(2026), F.lit(True)), key(F.lit("US"), e, e, F.lit(2026), F.lit(True)))[0] == "US|SEN||2026|True"
    assert one(spark, elections.winner_prediction(F.lit(0.3), F.lit(0)), elections.winner_prediction(F.lit(0.3), F.lit(1))) == (0.7, 0.3)
    day = 1730764800  # 2024-11-05
    m = spark.createDataFrame([(1, "kalshi", day + 129600, day), (2, "polymarket", 1736942400, None), (3, "kalshi", 1736942400, None)], "market_id int, platform string, close_ts long, election_day long")
    t = spark.createDataFrame([(k, ts) for k, c in ((1, day + 86399), (2, 1736856000), (3, 1736899200)) for ts in (c, c + 1)] + [(9, 5)], "market_id int, ts long")
    assert sorted(tuple(r) for r in elections.truncate(t, m).collect()) == [(1, day + 86399), (2, 1736856000), (3, 1736899200), (9, 5)]
    d = lambda s, l, p: traders.direction(F.lit(s), F.lit(l), F.lit(p))  # noqa: E731, E741
    assert one(spark, d("BUY", "Yes", "Republican"), d("SELL", "Yes", "Republican"), d("BUY", "Yes", "Democrat"), d("BUY", "Yes", "Green")) == (True, False, False, None)


def test_slugs_and_keys(spark):
    assert one(spark, *[tx.number_slug(F.lit(float(v))) for v in (4.5, 100000, 1000000, -3)]) == ("4P5", "100K", "1M", "N3")
    assert one(spark, *[tx.name_slug(F.lit(v)) for v in ("Donald Trump", "Ursula von der Leyen", "José García", "Oscar de la Hoya", "")]) == ("TRUMP", "LEYEN", "GARCIA", "LA_HOYA", None)
    f = spark.createDataFrame([("Will someone win the Minnesota Senate election in 2026?",), ("Will Donald Trump win the 2024 presidential election?",), ("Will inflation exceed 3.5% in 2025?",)], "question string")
    got = frames.extract(f).orderBy(F.desc(F.col("question").contains("Minnesota")), F.desc(F.col("question").contains("Trump"))).select(frames.race_key(F.col("frame")), frames.event_id(F.col("frame"))).collect()
    assert got[0][0] == "BWR-ELEC-US-SEN-MN-WIN-2026" and got[1][1] == "BWR-ELEC-XX-PRES-TRUMP-WIN-2024"
    p = one(spark, frames.parse_id(F.lit("BWR-ELEC-US-SEN-MN-WIN-2026-PRI")))[0]
    assert (p.type, p.country, p.office, p.year, p.is_primary) == ("ELEC", "US", "SEN", 2026, True)


def test_fuzzy_names():
    assert _similarity("donald trump", "donald trump") == 100
    assert _similarity("donald trump", "joe biden") < 50 and _similarity("donald j trump", "donald trump") >= 80 and _similarity("trump", "donald trump") >= 60


FRAME = "frame struct<frame_type:string,candidate:string,party:string,office:string,country:string,scope:string,year:int,outcome_type:string,is_primary:boolean,metric:string,threshold_value:double,threshold_direction:string,actor:string>"


def test_matching(spark):
    c = ("contest", "Donald Trump", None, "PRES", "US", None, 2024, "WIN", False, None, None, None, None)
    t = ("threshold", None, None, None, None, None, 2025, None, False, "CPI", 5000.0, "ABOVE", None)
    with_ = lambda f, **k: tuple(k.get(n, v) for n, v in zip(("frame_type", "candidate", "party", "office", "country", "scope", "year", "outcome_type", "is_primary", "metric", "threshold_value", "threshold_direction", "actor"), f))
    pairs = [(1, c, c), (2, c, with_(c, year=2028)), (3, t, t), (4, t, with_(t, threshold_value=6000.0)), (5, t, with_(t, metric="GDP")), (6, c, with_(c, candidate="Joe Biden"))]
    df = spark.createDataFrame(pairs, f"id int, {FRAME.replace('frame ', 'a ', 1)}, {FRAME.replace('frame ', 'b ', 1)}")
    df = df.withColumn("names", matching.name_score(F.col("a.candidate"), F.col("b.candidate")))
    got = {r.id: r.s for r in df.select("id", matching.confidence(F.col("a"), F.col("b"), F.col("names")).alias("s")).collect()}
    assert got[1] >= 0.8 and got[3] >= 0.8 and got[2] == got[4] == got[5] == got[6] == 0
    k = spark.createDataFrame([(1, "x", c), (2, "x", c)], f"id int, category string, {FRAME}")
    p = spark.createDataFrame([(7, "x", c), (8, "y", c)], f"id int, category string, {FRAME}")
    assert [(r.k_id, r.p_id) for r in matching.assign(matching.candidates(k, p)).collect()] == [(1, 7)]
    old = spark.createDataFrame([("e", 1, 0.8), ("f", 2, 0.5)], "event string, k int, conf double")
    new = spark.createDataFrame([("e", 3, 0.8), ("f", 4, 0.6), ("g", 5, 0.1)], "event string, k int, conf double")
    assert sorted(r.k for r in matching.keep_best(old, new, "event", "conf").collect()) == [1, 4, 5]


def test_quality(spark):
    shares = spark.createDataFrame([(e, 0.51234, 0.4) for e in "abc"] + [(e, 0.6, 0.3) for e in "ab"], "e string, d double, r double")
    assert quality.repeated_pairs(shares, "e", "d", "r").count() == 1
    issues = spark.createDataFrame([("x", "WARNING", 3), ("y", "CRITICAL", 0), ("z", "ERROR", 1)], "rule string, level string, n int")
    assert quality.report(issues).first().status == "ERROR"
    assert quality.missing_columns(shares, ["e", "z"]) == ["z"]


def test_least_squares_matches_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    y = 1 + x @ [2, -3] + rng.normal(size=200)
    df = spark.createDataFrame([(float(a), float(b), float(c), i % 20) for i, ((a, b), c) in enumerate(zip(x, y))], "a double, b double, y double, g int")
    got = {r.term: r for r in stats.ols(df, "y", ["a", "b"]).collect()}
    design = np.column_stack([np.ones(200), x])
    beta, rss, *_ = np.linalg.lstsq(design, y, rcond=None)
    se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * rss[0] / 197)
    assert [got[t].coef for t in ("intercept", "a", "b")] == pytest.approx(beta.tolist()) and [got[t].se for t in ("intercept", "a", "b")] == pytest.approx(se.tolist())
    e = y - design @ beta
    s = np.array([(design[np.arange(200) % 20 == g] * e[np.arange(200) % 20 == g, None]).sum(axis=0) for g in range(20)])
    inv = np.linalg.inv(design.T @ design)
    want = np.sqrt(np.diag(20 / 19 * 199 / 197 * inv @ s.T @ s @ inv))
    assert [r.se for r in stats.ols(df, "y", ["a", "b"], cluster="g").collect()] == pytest.approx(want.tolist())
    b = stats.bootstrap_mean(df, "y", 400).first()
    assert abs((b.high - b.low) / 3.92 - y.std() / np.sqrt(200)) < 0.05


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"t1": [{"t": 1, "p": 0.5}, {"t": 2, "p": 0.6}], "t2": []}))
    assert readers.series_map(spark, f"{tmp_path}/a.json").count() == 2
    (tmp_path / "c.json").write_text(json.dumps({"k": [{"end_period_ts": 9, "price": {"close": None, "previous": 40}, "yes_bid": {"close": 1}, "yes_ask": {"close": 2}}]}))
    assert tuple(readers.candle_map(spark, f"{tmp_path}/c.json").first()) == ("k", 9, 0.4)
    (tmp_path / "m.csv").write_text("id,v\n0012345678901234567890,1.5\n")
    assert readers.csv(spark, f"{tmp_path}/m.csv", "id string, v double", ["id"]).first().id == "0012345678901234567890"
    assert readers.newest(spark, f"{tmp_path}/*.csv").endswith("m.csv")
    pages = tmp_path / "pages"
    pages.mkdir()
    for n in range(3):
        (pages / f"page-{n}.json").write_text(json.dumps({"items": [{"id": n * 2}, {"id": n * 2 + 1}], "next": n < 2}))
    assert sorted(r.id for r in readers.paged(spark, str(pages)).collect()) == list("012345")
    df = spark.createDataFrame([("a", 2, 0.25), ("a", 1, None)], "k string, t int, v double")
    assert sinks.column_json(df, "k", "t", ["v"]).first().json.startswith('{"t":[1,2]')
    assert [sinks.save_version(df, f"{tmp_path}/v", f"{n:03d}", keep=2) for n in range(3)][-1] == ["002", "001"]
    assert sinks.latex_rows(df, ["k", "v"]).collect()[0].row == "a & 0.2500 \\\\"
    assert readers.until(df, "t", "1").count() == 1 and readers.until(df, "t", None).count() == 2


def test_serving_table(spark):
    a = spark.createDataFrame([("x", 1, 0.1), ("y", 5, 0.2)], "k string, at int, v double")
    b = spark.createDataFrame([("x", 2, 0.3), ("y", 4, 0.9)], "k string, at int, v double")
    got = live.upsert(a, b, "k", "at")
    assert sorted((r.k, r.v) for r in got.collect()) == [("x", 0.3), ("y", 0.2)]
    assert live.unexpired(got, "at", 33, 30).count() == 1


def test_t_distribution():
    from foretell.functions.numbers import t_quantile, t_two_sided

    # printed tables: 97.5 % points, and tails worked out by hand for one and two degrees of freedom
    assert t_quantile(0.95, 10) == pytest.approx(2.228138852, rel=1e-7) and t_quantile(0.95, 1) == pytest.approx(12.70620474, rel=1e-7) and t_quantile(0.95, 1e7) == pytest.approx(1.959964, rel=1e-5)
    assert t_two_sided(1.0, 1) == pytest.approx(0.5) and t_two_sided(2.0, 2) == pytest.approx(1 - 2 / 6**0.5) and t_two_sided(0.0, 5) == 1.0 and t_two_sided(-3.0, 30) == t_two_sided(3.0, 30)
    assert t_two_sided(None, 3) is None and t_two_sided(1.0, 0) is None and 0 <= t_two_sided(300.0, 50) < 1e-80


def test_least_squares_like_numpy(spark):
    import numpy as np

    from foretell.functions.numbers import t_quantile
    from foretell.operators import stats

    rng = np.random.default_rng(1)
    x, z, g = rng.normal(0, 1, 300), rng.normal(0, 1, 300), rng.integers(0, 25, 300)
    y = 1 + 2 * x - z + rng.normal(0, 1, 300) + g / 10
    df = spark.createDataFrame(list(zip(y.tolist(), x.tolist(), z.tolist(), g.tolist())), "y double, x double, z double, g long")
    a = np.stack([np.ones(300), x, z], axis=1)
    inverse, n, k = np.linalg.inv(a.T @ a), 300, 3
    beta = inverse @ a.T @ y
    e = y - a @ beta
    plain = np.sqrt(np.diag(inverse) * (e @ e) / (n - k))
    sums = np.stack([(a[g == c] * e[g == c, None]).sum(axis=0) for c in np.unique(g)])
    groups = len(sums)
    clustered = np.sqrt(np.diag(groups / (groups - 1) * (n - 1) / (n - k) * inverse @ (sums.T @ sums) @ inverse))
    for cluster, se, freedom in ((None, plain, n - k), ("g", clustered, groups - 1)):
        got = stats.ols(df, "y", ["x", "z"], cluster=cluster).collect()
        assert [r.coef for r in got] == pytest.approx(beta.tolist()) and [r.se for r in got] == pytest.approx(se.tolist())
        assert [r.high - r.coef for r in got] == pytest.approx((t_quantile(0.95, freedom) * se).tolist()) and all(0 <= r.p_value <= 1 for r in got)


def test_forest_importance_finds_the_feature_that_matters(spark):
    from foretell.operators import stats

    rows = spark.range(3000).select(F.col("id"), *[((F.xxhash64(F.lit(k), F.col("id") % 600) % 1000) / 1000.0).alias(c) for k, c in enumerate("abc")]).withColumn("y", F.col("a") * 3 + F.col("b") * 0.5)
    got = {r.feature: r for r in stats.forest_importance(rows.withColumn("key", F.col("id") % 600), "key", ["a", "b", "c"], "y").collect()}
    assert got["a"].r2 > 0.9 and got["a"].importance > 10 * abs(got["b"].importance) and abs(got["c"].importance) < 0.02
    assert stats.forest_importance(rows.withColumn("key", F.col("id") % 600), "key", ["a", "b", "c"], "y").collect() == list(got.values())


def test_forest_trains_on_partitions_of_few_rows(spark, monkeypatch):
    from pyspark.ml.regression import RandomForestRegressor

    from foretell.operators import stats

    sizes, real = [], RandomForestRegressor.fit
    monkeypatch.setattr(RandomForestRegressor, "fit", lambda self, df, *a: sizes.extend(df.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()) or real(self, df, *a))
    rows = spark.range(3000).select(F.col("id").alias("key"), (F.xxhash64("id") % 1000 / 1000.0).alias("a")).withColumn("y", F.col("a") * 3)
    got = stats.forest_importance(rows, "key", ["a"], "y", trees=3, bucket=100).collect()
    assert got[0].r2 > 0.9 and 2000 < sum(sizes) < 3000 and max(sizes) < 200


def test_correlation_with_a_column_that_never_changes(spark):
    import numpy as np

    from foretell.functions.numbers import corr

    rows = spark.createDataFrame([(float(k), 0.1, None if k == 3 else k * k - 5.0 * k, "a") for k in range(7)] + [(1.0, 2.0, None, "b")], "x double, same double, y double, g string").repartition(5)
    got = {r.g: r for r in rows.groupBy("g").agg(corr("x", "same").alias("c"), corr("x", "y").alias("r"), corr("same", F.col("x") + 0).alias("d")).collect()}
    assert np.isnan(got["a"].c) and np.isnan(got["a"].d) and np.isnan(got["b"].c) and got["b"].r is None
    k = np.array([0, 1, 2, 4, 5, 6.0])
    assert got["a"].r == pytest.approx(np.corrcoef(k, k * k - 5 * k)[0, 1])


def test_bootstrap_limits(spark):
    from foretell.operators import stats

    rows = spark.range(2000).select("id", (F.col("id") % 10).cast("double").alias("v"))
    r = stats.bootstrap_mean(rows, "v", 300).first()
    assert abs(r.mean - 4.5) < 0.02 and 0.8 * 2 * 1.96 * 2.872 / 2000**0.5 < r.high - r.low < 1.2 * 2 * 1.96 * 2.872 / 2000**0.5


def test_exact_quantiles(spark):
    import numpy as np

    from foretell.operators.ranks import quantiles

    values = [float(k % 37) for k in range(500)] + [1000.0, -5.0]
    shares = [0, 0.1, 1 / 3, 0.5, 0.9, 1]
    assert quantiles(spark.createDataFrame([(v,) for v in [*values, None]], "v double"), "v", shares) == pytest.approx(np.quantile(values, shares).tolist())
    assert quantiles(spark.createDataFrame([], "v double"), "v", shares) == []


def test_paged_listing_ends_where_a_page_says_so(spark, tmp_path):
    for n in range(130):
        (tmp_path / f"page-{n}.json").write_text('{"items": [{"id": %d, "x": "y"}], "next": %s}' % (n, "true" if n < 119 else "false"))
    assert sorted(int(r.id) for r in readers.paged(spark, str(tmp_path)).collect()) == list(range(120))


def test_window_means_by_join_like_by_scan(spark):
    left = spark.createDataFrame([(m, x, at) for m in range(6) for x, at in (("a", 50), ("b", 90))], "market_id long, cut string, at long")
    ticks = spark.createDataFrame([(k % 5, (k * 37) % 100, k, None if k % 7 == 0 else (k % 11) / 10.0) for k in range(60)] + [(4, 50, 99, 0.3)], "market_id long, ts long, ord long, price double")
    made = lambda how: sorted(tuple(r) for r in pricing.window_means(left, ticks, "at", {"spot": -1, "m": 30}, lasts={"twice": F.col("price") * 2}, strategy=how).select("market_id", "cut", "spot", "m", "twice").na.fill(-1.0).collect())
    assert made("agg") == made("scan") and len(made("agg")) == 12


def test_index_lists_are_made_where_their_block_is(spark, tmp_path):
    from foretell.operators.search_index import SearchIndex

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = spark.range(400).select("id", F.concat(F.lit("word"), F.col("id"), F.lit(" common")).alias("text"))
    index = SearchIndex.build(rows, "id", ["text"], str(tmp_path / "i"), block=20)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = spark.read.parquet(str(tmp_path / "i" / "postings")).select("block", F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).alias("part")).distinct().collect()
    assert len({r.part for r in parts}) > 1 and len(parts) == len({r.block for r in parts})
    assert index.phrase("word39").count() == 11 and index.all_words("mon common").count() == 400
