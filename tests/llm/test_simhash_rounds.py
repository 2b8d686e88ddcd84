"""Rounds of the near duplicates by similarity end once no link is new."""

import random
import time

from foretell.llm import simhash


def test_groups_are_whole_after_few_rounds(spark, monkeypatch):
    """40 groups of 12 texts, each pair of a group at 0.81 and more: key by key they share buckets with a part of their group only."""
    draw = random.Random(5)
    rows = []
    for group in range(40):
        base = [f"w{draw.randrange(10**6)}" for _ in range(200)]
        for member in range(12):
            words = list(base)
            for at in draw.sample(range(200), 2):
                words[at] = f"v{draw.randrange(10**6)}"
            rows.append((group * 12 + member, " ".join(words)))
    calls, real = [], simhash._found
    monkeypatch.setattr(simhash, "_found", lambda *args: calls.append(1) or real(*args))
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 480, 12))
    assert len(calls) <= 4


def test_later_rounds_read_only_what_failed(spark, monkeypatch):
    """Buckets whose links all held are not read again, and small buckets are settled pair by pair."""
    draw = random.Random(6)
    rows = []
    for group in range(60):
        base = [f"w{draw.randrange(10**6)}" for _ in range(200)]
        for member, changes in enumerate((0, 1, 1, 9, 9) if group < 10 else (0, 1)):  # nine changes: some pairs are below 0.8
            words = list(base)
            for at in draw.sample(range(200), changes):
                words[at] = f"v{draw.randrange(10**6)}"
            rows.append((group * 5 + member, " ".join(words)))
    read, real = [], simhash._found
    monkeypatch.setattr(simhash, "_found", lambda *args: read.append(args[0].count()) or real(*args))
    simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(read) <= 3 and (len(read) < 3 or read[2] < read[1] / 2)


def test_written_tables_leave_no_shuffle_files(spark):
    import glob

    from foretell.llm.common import materialise

    local = spark.sparkContext._jvm.org.apache.spark.util.Utils.getLocalDir(spark.sparkContext._jsc.sc().conf())
    files = lambda: {f for f in glob.glob(f"{local}/../**/shuffle_*.data", recursive=True)}
    before = files()
    materialise(spark.range(5000).groupBy("id").count())
    for _ in range(50):  # files go beside the program
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before
