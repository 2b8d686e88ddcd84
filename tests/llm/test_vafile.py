import math

import numpy as np
import pytest

from foretell.llm import vafile
from foretell.llm.vafile import top_k


def plain(rows, asked, k):
    good = {i: [math.floor(256 * float(x)) for x in v] for i, v, *_ in rows if v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in asked:
        if q in good:
            scores = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [2048, 20])
def test_like_brute_force(spark, block, monkeypatch):
    """In one block and in many, over several rounds."""
    monkeypatch.setattr(vafile, "VECTORS", block)
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 8)], i % 3) for i in range(400)]
    hot = rows[7][1]
    rows += [(1000 + i, hot, 0) for i in range(90)] + [(2000, None, 1), (2010, [1.0] * 7 + [None], 1), (2020, [1.0] * 7 + [float("nan")], 1), (2030, [float("inf")] * 8, 1), (2040, [], 1), (2050, [0.5, 0.25], 0), (2060, [0.5, -0.25], 0)]
    docs = spark.createDataFrame(rows + rows[:20], "vec_id long, embedding array<float>, score int")
    queries = docs.filter("vec_id % 10 = 0")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(docs, queries, 5).collect())
    assert got == plain(rows, [i for i, *_ in rows if i % 10 == 0], 5)


def test_few_and_empty(spark):
    docs = spark.createDataFrame([(0, [0.5]), (1, [0.25])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in top_k(docs, docs.filter("vec_id = 0")).collect()] == [(0, 1, 1, 128 * 64)]
    assert top_k(docs.limit(0), docs.limit(0)).count() == 0


def test_one_far_component_and_huge_ones(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 6)]) for i in range(200)] + [(500, [1e9, 0.0, 0.0, 0.0, 0.0, 0.0]), (510, [0.0, -3e9, 0.0, 0.0, 0.0, 1.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = [i for i, _ in rows if i % 10 == 0]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(docs, docs.filter("vec_id % 10 = 0"), 5).collect())
    assert got == plain(rows, asked, 5)
    # a score beyond the range of long stands at its end
    far = spark.createDataFrame([(1, [3e9, 3e9]), (2, [3e9, 3e9]), (3, [-3e9, -3e9])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in top_k(far, far.filter("vec_id = 1")).orderBy("rank").collect()] == [(2, 2**63 - 1), (3, -(2**63))]
