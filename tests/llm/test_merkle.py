import hashlib
import random

import pytest
from pyspark.sql import functions as F

from foretell.llm.merkle import leaves, manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def collapse(nodes):
    """All levels, and for each leaf its path: (left, right) siblings by level."""
    levels, paths = [nodes], [[] for _ in nodes]
    while len(levels[-1]) > 1:
        own = levels[-1]
        for i, path in enumerate(paths):
            at = i // 3 ** (len(levels) - 1)
            run = at - at % 3
            path.append(("".join(own[run:at]), "".join(own[at + 1 : run + 3])))
        levels.append([h(*own[i : i + 3]) for i in range(0, len(own), 3)])
    return levels[-1][0], paths


def plain(rows, change):
    """By (doc_id, leaf): subroot, root, proof, folded root, verified.  rows: doc_id, source, lang, n_chars, text."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = (own, *collapse([leaf(r) for r in own]))
    root, tops = collapse([trees[s][1] for s in names])
    out = []
    for s, top in zip(names, tops):
        own, subroot, paths = trees[s]
        for r, path in zip(own, paths):
            path, node = path + top, leaf(change(r))
            for left, right in path:
                node = h(left, node, right)
            out.append((r[0], leaf(r), subroot, root, h(*[a + b for a, b in path]), node, node == root))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def changed(r):
    return r if r[4] is None or r[0] is None or r[0] % 2 else (*r[:4], r[4].replace("\n", ""))


def found(docs, height):
    text = F.when(F.col("doc_id") % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    got = manifest(leaves(docs, changed={"text": text}), height)
    return sorted([tuple(r) for r in got.select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()], key=str)


@pytest.mark.parametrize("height", [1, 2, 6])
def test_like_plain_trees(spark, height):
    rng = random.Random(height)
    rows = [(i, "hot", "en", 5, f"te\nxt {i % 7}") for i in range(200)]
    rows += [(1000 + i, f"s{i % 5}", None, None, rng.choice(["", "a\n", "é🙂", None])) for i in range(40)]
    rows += [(2000, None, None, 1, None), (2001, "", "", 0, ""), (2002, "Ω", "x", 2, "b\nb" * 40_000), (None, "hot", "en", 1, "no\nid"), (7, "s1", "en", 1, "again"), (7, "s1", "en", 1, "other")]
    rows += [(8, "twice", "en", 1, "same\nrow")] * 4
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("k")).withColumn("leaf", F.lit(1)).withColumn("pos", F.lit(2)).repartition(6)
    assert found(docs, height) == plain(rows, changed)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28])
def test_sizes_around_full_runs(spark, n):
    rows = [(i, "a", "x", i, f"\n{i}") for i in range(n)]
    assert found(spark.createDataFrame(rows, SCHEMA), 1) == plain(rows, changed)
    many = [(i, f"s{i:03}", "x", i, f"\n{i}") for i in range(n)]
    assert found(spark.createDataFrame(many, SCHEMA), 2) == plain(many, changed)


def test_without_changes_all_verify(spark):
    docs = spark.createDataFrame([(i, str(i % 3), None, i, "t") for i in range(50)], SCHEMA)
    assert {r.verified for r in manifest(leaves(docs)).collect()} == {True}


def test_empty_table_and_no_python(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert manifest(leaves(docs)).count() == 0
    assert "Python" not in manifest(leaves(docs))._jdf.queryExecution().toString()
