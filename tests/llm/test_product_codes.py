import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from foretell.llm.product_codes import codebooks_digest, errors_by_label, product_codes

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, parts, entries, rounds, scale):
    """Whole numbers of any size throughout."""
    kept = [(i, v, lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v) and len(v) % parts == 0]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return None
    n = len(kept[0][1])
    kept = [(i, [math.floor(Fraction(x) * scale) for x in v], lab) for i, v, lab in kept if len(v) == n]
    width = n // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [list(b) for b in zip(*[cut(v) for _, v, _ in kept[:entries]])]

    def assign(v):
        far = [[sum((a - b) ** 2 for a, b in zip(part, e)) for e in books[p]] for p, part in enumerate(cut(v))]
        return [(f.index(min(f)), min(f)) for f in far]

    for _ in range(rounds):
        codes = [assign(v) for _, v, _ in kept]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(v)[p] for (_, v, _), c in zip(kept, codes) if c[p][0] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    errors = [sum(f for _, f in assign(v)) for _, v, _ in kept]
    by = {}
    for (_, _, lab), e in zip(kept, errors):
        by[lab] = by.get(lab, 0) + e
    fits = lambda x: x if x < 2**63 else None
    out = [(i, [c for c, _ in assign(v)], fits(e), None if any(fits(x) is None for (_, _, y), x in zip(kept, errors) if y == lab) else fits(by[lab])) for (i, v, lab), e in zip(kept, errors)]
    return books, sorted(out, key=str)


def check(spark, rows, parts=2, entries=4, rounds=3, scale=16, partitions=3):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("code", F.lit("c")).withColumn("error", F.lit("e")).repartition(partitions)
    got, want = product_codes(docs, parts, entries, rounds, scale), plain(rows, parts, entries, rounds, scale)
    assert got.codebooks.tolist() == want[0]
    assert sorted([tuple(r) for r in errors_by_label(got.codes).select("vec_id", "code", "error", "label_error").collect()], key=str) == want[1]
    return got


def test_like_plain_rounds(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), rng.normal(size=6).tolist(), int(i) % 3 or None) for i in rng.permutation(150)]
    rows += [(900 + i, [0.5] * 6, 1) for i in range(60)]  # one hot vector
    rows += [(-1, None, 1), (-2, [], 1), (-3, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (-4, [float("nan")] + [0.0] * 5, 1), (-5, [float("inf")] + [0.0] * 5, 2), (-6, [1.0] * 5, 2), (500, [1.0] * 8, 2), (None, [0.25] * 6, 7), (3, [0.1] * 6, 1)]
    check(spark, rows)


def test_ties_and_unused_entries(spark):
    rows = [(i, [float(i // 2 % 2), 0.0], 0) for i in range(20)]  # equal entries: the lower index takes all
    got = check(spark, rows, parts=2, entries=6)
    assert got.codebooks.shape == (2, 6, 1)


def test_fewer_vectors_than_entries(spark):
    check(spark, [(1, [1.0, -2.0], None), (2, [-1.0, 2.5], 3)], entries=16)


@pytest.mark.parametrize("size", [3e4, 1e9, 1e18, 1e300])
def test_components_of_any_size(spark, size):
    rng = np.random.default_rng(1)
    check(spark, [(i, (rng.normal(size=4) * size).tolist(), i % 2) for i in range(40)])


def test_nothing_kept(spark):
    assert product_codes(spark.createDataFrame([(1, None, 1), (2, [float("nan")], 1)], SCHEMA)) is None
    assert product_codes(spark.createDataFrame([], SCHEMA)) is None


def test_digest_names_components_in_order():
    import hashlib

    assert codebooks_digest(np.array([[[1, -2], [3, 4]], [[5, 6], [7, 8]]])) == hashlib.sha256(b"1,-2,3,4,5,6,7,8").hexdigest()
