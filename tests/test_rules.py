import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foretell.operators import binning, quality, search, stats
from foretell.sources import readers


def test_least_squares_of_few_rows(spark):
    rows = lambda data: spark.createDataFrame(data, "y double, x double")
    assert stats.ols(rows([]), "y", ["x"]).count() == 0
    assert stats.ols(rows([(None, 1.0)]), "y", ["x"]).count() == 0
    two = {r.term: r for r in stats.ols(rows([(1.0, 0.0), (3.0, 1.0)]), "y", ["x"]).collect()}
    assert two["x"].coef == pytest.approx(2) and two["x"].se is None and two["x"].n == 2
    flat = {r.term: r for r in stats.ols(rows([(1.0, float(k)) for k in range(5)]), "y", ["x"]).collect()}
    assert flat["x"].coef == pytest.approx(0, abs=1e-12) and flat["x"].r2 is None


def test_density_like_plain(spark):
    rng = np.random.default_rng(0)
    v = np.round(rng.normal(50, 9, 400), 1)
    got = sorted(map(tuple, stats.kde(spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double"), "v", 21).collect()))
    h = v.std(ddof=1) * len(v) ** -0.2
    want = [(x, np.exp(-(((x - v) / h) ** 2) / 2).sum() / (len(v) * h * math.sqrt(2 * math.pi))) for x in np.linspace(0, 100, 21)]
    assert np.allclose(got, want)
    one = stats.kde(spark.createDataFrame([(5.0,)] * 3, "v double"), "v", 5)
    assert [r.density for r in one.collect()] == [0.0] * 5
    assert stats.kde(spark.createDataFrame([], "v double"), "v", 5).count() == 0


def test_paired_calibration(spark):
    rng = np.random.default_rng(1)
    rows = [("a", round(float(rng.random()), 1), float(rng.random()), int(rng.random() < 0.5), i) for i in range(107)] + [("b", 0.5, 0.5, 1, i) for i in range(49)] + [("a", None, 0.1, 1, 900), ("a", 0.1, None, 1, 901)]
    got = {(r.g, r.bin): tuple(r)[2:] for r in binning.paired_calibration(spark.createDataFrame(rows, "g string, p double, q double, y int, id int"), "g", "p", "q", "y", "id").collect()}
    own = sorted([r for r in rows if r[0] == "a" and None not in r], key=lambda r: (r[1], r[4]))
    for b in range(20):
        part = own[b * 5 : (b + 1) * 5 if b < 19 else None]
        assert got["a", b] == pytest.approx((len(part), *(np.mean([r[k] for r in part]) for k in (1, 2, 3))))
    assert len(got) == 20


def test_life_fraction_without_a_window(spark):
    df = spark.createDataFrame([("a", 0), ("a", 5), ("a", 10), ("b", 3), (None, 1), (None, 3)], "k string, t int")
    out = binning.life_fraction(df, "k", "t")
    assert "Window" not in out._jdf.queryExecution().toString()
    assert sorted(((r.k, r.t, r.life) for r in out.collect()), key=str) == sorted([("a", 0, 0.0), ("a", 5, 0.5), ("a", 10, 1.0), ("b", 3, 0.0), (None, 1, 0.0), (None, 3, 1.0)], key=str)


def test_required_columns_and_coverage(spark):
    df = spark.createDataFrame([("a", None, "1. X"), ("b", 2, "1. X"), ("c", None, "2. Y")], "k string, v int, c string")
    assert [tuple(r) for r in quality.required_columns(df, ["k", "v", "z"]).collect()] == [("k", True, 3, 0.0), ("v", True, 1, pytest.approx(2 / 3)), ("z", False, 0, 1.0)]
    r = quality.covered(df, F.col("c").startswith("1"), ["k", "v", "z"]).first()
    assert (r.n, r.missing_k, r.missing_v, r.missing_z, r.too_low) == (2, 0, 1, 2, True) and r.coverage == pytest.approx(0.5)
    none = quality.covered(df, F.lit(False), ["k"]).first()
    assert none.coverage == 1.0 and not none.too_low


def test_overlap(spark):
    df = spark.createDataFrame([(1, "polymarket", 0.5, 1), (1, "kalshi", 0.7, 2), (2, "kalshi", 0.1, 3), (3, "polymarket", 0.2, 4), (4, "kalshi", 0.2, 5), (4, "third", 0.2, 6)], "e int, v string, p double, id int")
    got = {r.e: r for r in quality.overlap(df, ["e"], "v", "p", "id").collect()}
    assert {k: r.side for k, r in got.items()} == {1: "both", 2: "kalshi", 3: "polymarket", 4: "other"}
    assert (got[1].first_polymarket, got[1].first_kalshi, got[2].n_polymarket) == (1, 2, 0)


def test_merge_aligned(spark):
    master = spark.createDataFrame([(1, 1.5, "YES"), (2, None, "Maybe")], "id int, v double, o string")
    new = spark.createDataFrame([("1", "9", "no", "x"), ("3", "bad", "nO", "x"), ("4", "2", None, "x")], "ID string, v string, o string, more string")
    got = quality.merge_aligned(master, new, ["id"], {"ID": "id"}, "o")
    assert got.schema.simpleString() == master.schema.simpleString()
    assert sorted(map(tuple, got.collect())) == [(1, 1.5, "Yes"), (2, None, "Maybe"), (3, None, "No"), (4, 2.0, None)]


def test_by_slug(spark):
    df = spark.createDataFrame([("Some-Slug", 1, 5.0), ("some-slug", 2, 9.0), (None, 3, 1.0)], "slug string, id int, v double")
    assert [r.id for r in search.by_slug(df, "slug", "SOME-slug", [F.desc("v")]).collect()] == [2]
    assert search.by_slug(df, "slug", "none", [F.desc("v")]).count() == 0


def test_a_large_file_of_one_object_is_refused(spark, tmp_path, monkeypatch):
    (tmp_path / "m.json").write_text('{"a": [{"t": 1, "p": 0.5}]}')
    assert readers.series_map(spark, str(tmp_path / "*.json")).count() == 1
    monkeypatch.setattr(readers, "MOST_BYTES", 10)
    with pytest.raises(ValueError):
        readers.series_map(spark, str(tmp_path / "m.json"))
    assert readers.series_map(spark, str(tmp_path), lines=True).count() == 1
