import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(4)
    words = "the of and reading water house under morning letter garden people winter stone river".split()
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, say(rng.randint(30, 400)), "en", f"s{i % 3}" if i % 2 else "hot", 1) for i in range(240)]
    rows += [(300 + i, rows[i][1] + " ", "en", "hot", 1) for i in range(10)]  # exact copies, longer
    long = say(1500)
    rows += [(400 + i, long + f" extra{i}", "en", "hot", 1) for i in range(6)]  # near copies
    rows += [(500 + i, " ".join(w.upper() + "%%%" for w in say(80).split()), "en", "s1", 1) for i in range(8)]  # junk
    rows += [(600, "", None, None, 0), (601, None, "en", "s1", None)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 240, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf_dir))
        assert docs.columns == columns
        rows = docs.collect()
        ids[name] = [r.doc_id for r in rows]
        assert len(set(ids[name])) == len(ids[name])
    assert set(range(500, 508)) & set(ids["quality"]) == set() and len(ids["quality"]) >= 250
    first = set(ids["quality"])
    assert set(ids["exact_dedup"]) == first - {i for i in range(10) if 300 + i in first} - {601 if 600 in first else -1}
    assert len(set(ids["near_dedup"]) & set(range(400, 406))) == 1
    assert set(ids["near_dedup"]) - set(range(400, 406)) == set(ids["exact_dedup"]) - set(range(400, 406))
    assert sorted(ids["mixing"]) == sorted(ids["near_dedup"])


def test_sequences_follow_the_mix(spark, sf_dir, tmp_path):
    """The order in which documents are written to the table decides the order of the sequences."""
    docs = spark.createDataFrame([(i, "word " * 700, "en", "s", 1) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    for k, order in enumerate((F.col("doc_id"), -F.col("doc_id"))):
        docs.repartitionByRange(3, order).sortWithinPartitions(order).write.parquet(f"{tmp_path}/{k}")
        corpus_pipeline.packing(spark, spark.read.parquet(f"{tmp_path}/{k}"), sf_dir).write.parquet(f"{tmp_path}/out{k}")
        got = spark.read.parquet(f"{tmp_path}/out{k}").select("doc_id", "_metadata.file_path", "_metadata.row_index").orderBy("file_path", "row_index").collect()
        assert [r.doc_id for r in got] == sorted(range(40), reverse=bool(k))


def test_run_packs_what_is_left(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert {0, 300}.isdisjoint({r.doc_id for r in rows}) is False
