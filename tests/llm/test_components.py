"""Components by rounds of joins, against union-find, and what a round costs."""

import random

import pytest
from pyspark.sql import functions as F

from foretell.llm import common, components
from foretell.llm.kneser_ney import keep_good


def plain(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for e in edges if e[0] != e[1] for x in e}


def graphs():
    draw = random.Random(3)
    shuffled = draw.sample(range(90), 90)
    return {"sparse": [(draw.randrange(60), draw.randrange(60)) for _ in range(40)], "path": list(zip(shuffled, shuffled[1:])), "star": [(7, k) for k in range(30)], "loops": [(1, 1), (2, 3), (3, 2)]}


@pytest.mark.parametrize("name", ["sparse", "path", "star", "loops"])
def test_labels_are_the_smallest_nodes(spark, name):
    edges = graphs()[name]
    df = spark.createDataFrame(edges, "a long, b long").select(F.struct(F.col("a").alias("id"), F.lit(0).alias("hash")).alias("u"), F.struct(F.col("b").alias("id"), F.lit(0).alias("hash")).alias("v"))
    got = {r.node.id: r.label.id for r in components.connected_components(df).collect()}
    assert got == plain(edges)


def test_a_round_works_out_each_step_once(spark, monkeypatch):
    """No step of a round is shuffled again for each of its uses."""
    exchanges, real = [], components.materialise
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(components, "materialise", lambda df: exchanges.append(plan(df).count("Exchange hashpartitioning")) or real(df))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        components.connected_components(spark.createDataFrame(graphs()["path"], "u long, v long"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert len(exchanges) > 4 and max(exchanges) <= 4


def test_the_quality_stage_leaves_one_small_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    docs = spark.createDataFrame([(k, "en", "abc def " * (k % 5 + 1)) for k in range(60)], "doc_id long, lang string, text string")
    kept = keep_good(docs, spark.createDataFrame([(k, 1) for k in range(0, 60, 2)], "doc_id long, quality int"))
    assert len([p for p in tmp_path.iterdir() if p.name.startswith("t-")]) == 1
    assert kept.count() == 60
