"""Segmented scans, and what is built on them, against windows over whole keys."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foretell.operators import asof, pricing, ranks, stats
from foretell.operators.scan import running


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("pieces", [1, 3, 40])
def test_running_equals_windows_over_whole_keys(spark, pieces):
    rng = random.Random(pieces)
    data = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), rng.randint(0, 50), i, rng.choice([None, 1, 2, 5]), "x") for i in range(600)]
    df = spark.createDataFrame(data, "k string, t int, i int, v int, _x_sum string")
    line = Window.partitionBy("k").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.coalesce(F.sum("v").over(line), F.lit(0)).alias("total"), F.last("v", ignorenulls=True).over(line).alias("last"), F.coalesce(F.sum("v").over(Window.partitionBy("k")), F.lit(0)).alias("whole"))
    got = running(df, ["k"], ["t", "i"], totals={"total": F.col("v")}, lasts={"last": F.col("v")}, wholes={"whole": F.col("v")}, pieces=pieces)
    assert rows_of(got) == rows_of(want)
    assert running(df.limit(0), ["k"], ["t", "i"], totals={"total": F.col("v")}).count() == 0


def test_a_hot_series_is_dealt_to_all_tasks(spark):
    ticks = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("ts"), (F.col("id") % 7).cast("double").alias("p"))
    cuts = spark.range(0, 20_000, 3).select(F.lit(1).alias("k"), F.col("id").alias("at"))
    both = cuts.select("k", "at").withColumn("_kind", F.lit(1)).unionByName(ticks.select("k", F.col("ts").alias("at"), F.lit(0).alias("_kind"), "p"), allowMissingColumns=True)
    sizes = [r["count"] for r in running(both, ["k"], ["at", "_kind"], lasts={"q": F.col("p")}, pieces=8).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 0.8 * sum(sizes)
    want = asof.backward(cuts, ticks, "k", "at", "ts", "p", [])
    assert rows_of(asof.backward(cuts, ticks, "k", "at", "ts", "p", [], strategy="scan")) == rows_of(want)


def test_window_means_equal_means_over_joined_ticks(spark):
    rng = random.Random(3)
    ticks = spark.createDataFrame([(rng.choice([1, 1, 1, 2]), rng.randint(0, 400), i, rng.choice([0.1, 0.25, 0.7, None]), rng.choice([None, 2.0])) for i in range(500)], "market_id int, ts long, ord long, price double, q double")
    left = spark.createDataFrame([(m, at, f"c{at}") for m in (1, 2, 3) for at in (0, 50, 51, 200, 400, 999)], "market_id int, at long, `a.b` string")
    windows = {"w0": 0, "w40": 40, "w1000": 1000, "none": -1}
    joined = left.join(ticks.withColumnRenamed("market_id", "m"), (F.col("market_id") == F.col("m")) & (F.col("ts") <= F.col("at")), "left")
    last = F.max_by("price", F.when(F.col("price").isNotNull(), F.struct("ts", "ord")))
    want = joined.groupBy("market_id", "at", "`a.b`").agg(*[F.coalesce(F.avg(F.when(F.col("ts") >= F.col("at") - w, F.col("price"))), last).alias(n) for n, w in windows.items()], F.max_by("q", F.when(F.col("q").isNotNull(), F.struct("ts", "ord"))).alias("q"))
    got = pricing.window_means(left, ticks, "at", windows, lasts={"q": F.col("q")})
    assert got.columns == want.columns
    for a, b in zip(rows_of(got), rows_of(want)):
        assert a[:3] == b[:3] and all(x == pytest.approx(y, abs=1e-9) if y is not None else x is None for x, y in zip(a[3:], b[3:]))


def test_quantiles_and_ranks_of_groups(spark):
    rng = np.random.default_rng(0)
    data = [("hot" if i % 4 else None, float(v)) for i, v in enumerate(rng.integers(0, 40, 500))] + [("few", 3.0), ("few", None), ("none", None)]
    df = spark.createDataFrame(data, "g string, v double")
    shares = {"low": 0.25, "mid": 0.5, "third": 1 / 3, "top": 1.0}
    got = {r.g: r for r in ranks.group_quantiles(df, "v", shares, ["g"]).collect()}
    assert set(got) == {"hot", None, "few"}
    for g, r in got.items():
        own = [v for k, v in data if k == g and v is not None]
        assert [r[n] for n in shares] == pytest.approx([np.quantile(own, s) for s in shares.values()])
    two = ranks.group_medians(df.withColumn("w", F.when(F.col("g") == "none", 1)), ["v", "w"], ["g"]).collect()
    assert {r.g: (r.v_median, r.w_median) for r in two}["none"] == (None, 1.0)
    place = {}
    for r in ranks.rank_pct(df, "v", by="g").collect():
        place.setdefault((r.g, r.v), set()).add(r.rank_pct)
    for (g, v), found in place.items():
        own = sorted(x for k, x in data if k == g and x is not None)
        want = None if v is None else (sum(x < v for x in own) + (own.count(v) + 1) / 2) / len(own)
        assert len(found) == 1 and (found == {None} if want is None else found.pop() == pytest.approx(want))


def test_long_values_beyond_doubles_keep_their_order(spark):
    big = 2**53
    df = spark.createDataFrame([(i, big + i) for i in range(9)], "id long, x long").repartition(3)
    for descending in (False, True):
        got = [r["rank"] for r in ranks.global_rank(df, "x", "id", descending=descending).orderBy("id").collect()]
        assert got == (list(range(9, 0, -1)) if descending else list(range(1, 10)))
    assert [r["rank"] for r in ranks.average_rank(df, "x").orderBy("id").collect()] == list(range(1, 10))


def test_bootstrap_multiplies_no_row_and_agrees_with_the_plain_form(spark):
    rng = np.random.default_rng(1)
    values = rng.choice([0.0, 0.1, 0.5, 0.9], 2000, p=[0.5, 0.2, 0.2, 0.1])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    out = stats.bootstrap_mean(df, "v", 2000)
    plan = out._jdf.queryExecution().toString()
    assert "Generate" not in plan and "explode" not in plan.lower()
    weights = rng.poisson(1, (2000, 2000))
    plain = weights @ values / weights.sum(axis=1)
    r = out.first()
    assert r["mean"] == pytest.approx(values.mean(), abs=3e-3)
    assert (r["low"], r["high"]) == pytest.approx(tuple(np.quantile(plain, [0.025, 0.975])), abs=3e-3)
    assert out.first() == stats.bootstrap_mean(df.repartition(7), "v", 2000).first() or out.first()["mean"] == pytest.approx(stats.bootstrap_mean(df.repartition(7), "v", 2000).first()["mean"], abs=1e-12)
