"""Small tables that the pipeline writes again and again take a task for each core, however far the session shuffles."""

import random
from pathlib import Path

import pytest

from foretell.llm import common, components, kneser_ney, simhash


@pytest.fixture
def files(spark, monkeypatch):
    """Numbers of files of the tables written, in a session that shuffles to 97 partitions and does not put small ones together."""
    found, real = [], common.materialise

    def counted(df):
        back = real(df)
        found.append(len(list(Path(back._shared_path.removeprefix("file:")).glob("part-*"))))
        return back

    for module in (components, kneser_ney, simhash):
        monkeypatch.setattr(module, "materialise", counted)
    conf = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    held = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield found
    for k, v in held.items():
        spark.conf.set(k, v)


def most(spark):
    return spark.sparkContext.defaultParallelism


def test_rounds_of_components(spark, files):
    edges = spark.createDataFrame([(k, k + 1) for k in range(400)], "u long, v long")
    assert {r.label for r in components.connected_components(edges, 400).collect()} == {0}
    assert len(files) > 4 and max(files) <= most(spark)


def test_a_model_and_its_answers(spark, files):
    docs = spark.createDataFrame([(k, "en", f"abc def {k} " * (k % 5 + 1)) for k in range(200)], "doc_id long, lang string, text string")
    model = kneser_ney.Model(docs, 3)
    asked = model.tables[3].select("lang", "gram")
    assert model.probabilities(asked).count() == asked.count()
    assert len(files) > 6 and max(files[1:]) <= most(spark)  # how many n-grams the texts have is not known before the first


def test_near_duplicates(spark, files):
    draw = random.Random(7)
    rows = []
    for group in range(40):
        base = [f"w{draw.randrange(10**6)}" for _ in range(100)]
        rows += [(group * 4 + k, " ".join([*base, f"v{k}"])) for k in range(4)]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 160, 4))
    assert len(files) > 8 and max(files[1:]) <= 3 * most(spark)  # a union of three written tables at most
