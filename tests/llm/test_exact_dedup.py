import hashlib
import re

import pytest
from pyspark.sql import functions as F

from foretell.llm.exact_dedup import drop_exact_duplicates, exact_duplicates

BLANK = re.compile("[\x20\x09-\x0d]")


def plain(rows):
    groups = {}
    for i, (doc_id, text) in enumerate(rows):
        groups.setdefault(BLANK.sub("", text or ""), []).append((-len(text or ""), doc_id if doc_id is not None else -1, i))
    return groups


@pytest.mark.parametrize("tracked", [2, 1024])
def test_like_brute_force(spark, tracked):
    rows = [(i, f"text number {i % 7}" + " " * (i % 3)) for i in range(80)] + [(100 + i, "hot  text") for i in range(90)] + [(200, None), (201, ""), (202, " \t\n\x0b\x0c\r"), (203, " "), (204, "é🙂 x" * 5000), (205, "é🙂x" * 5000)]
    docs = spark.createDataFrame([(a, b, "d", 1) for a, b in rows], "doc_id long, text string, digest string, length int").repartition(5)
    got = {r.doc_id: r for r in exact_duplicates(docs, tracked).collect()}
    assert len(got) == len(rows)
    for norm, members in plain(rows).items():
        keep = min(members)[1]
        for _, doc_id, _ in members:
            r = got[doc_id]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, len(members), doc_id == keep, hashlib.sha256(norm.encode()).hexdigest())
    left = drop_exact_duplicates(docs, tracked)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(min(m)[1] for m in plain(rows).values())


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (None, "b"), (3, "b"), (4, "c")], "doc_id long, text string")
    got = exact_duplicates(docs).collect()
    assert len(got) == 6 and sum(r.kept for r in got) == 3
    mixed = spark.createDataFrame([(1, "a b"), (1, "a  b"), (1, "other"), (2, "ab")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in drop_exact_duplicates(mixed).collect()) == [(1, "a  b"), (1, "other")]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in drop_exact_duplicates(docs).collect()) == [(False, 1), (False, 4), (True, 0)]


def test_empty_table_and_no_python(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_duplicates(docs).count() == 0
    plan = exact_duplicates(docs.withColumn("x", F.lit(1)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
