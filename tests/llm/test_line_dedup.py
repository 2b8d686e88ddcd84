import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foretell.llm.cuckoo import CuckooFilter, Full
from foretell.llm.line_dedup import LineIndex, drop_repeated_lines

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(BLANKS))


def plain(rows, index=None):
    """rows: (doc_id, text) -> sorted (doc_id, n_lines, n_dropped, kept text); index: the rows that are known, by default the same."""
    holders = {}
    for doc_id, text in rows if index is None else index:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(-1 if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == (-1 if doc_id is None else doc_id)]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def found(frame):
    return sorted(map(tuple, frame.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()), key=str)


def some_rows(seed, n=60, first=0):
    rng = random.Random(seed)
    lines = ["a line that repeats", "A LINE that repeats \t", "short", "", "  exactly10 ", "ÉTÉ is not lowered", "été is not lowered", "\x0bform feed line\x0c", "🙂🙂🙂🙂🙂🙂🙂🙂🙂🙂"] + [f"line number {i}" for i in range(50)]
    return [(first + i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 12)))) for i in range(n)]


def test_like_brute_force(spark):
    rows = some_rows(1) + [(200, None), (201, ""), (202, "\n\n"), (203, "the very same line\nthe very same line"), (204, "the very same line\nx"), (205, "a long text with a line\n" * 30_000 + "line number 7"), (206, "a long text with a line")]
    rows += [(None, "line number 3\nline number 4"), (None, "line number 5"), (5, "line number 1\nrow with a repeated id"), (5, "row with a repeated id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k1", F.lit("k")).withColumn("lost1", F.lit(1)).withColumn("shard", F.lit(2)).repartition(5)
    assert found(drop_repeated_lines(docs)) == plain(rows)


def test_hot_line_in_every_document(spark):
    rows = [(i, f"one line for everybody here\nits own line {i}\nfor three of them {i // 3}") for i in range(3000)]
    assert found(drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)


def test_empty_table(spark):
    assert drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(1, "a line of ten or more")], "doc_id long, text string")
    assert found(LineIndex(spark).drop_repeated(docs)) == [(1, 1, 0, "a line of ten or more")]


def state(index):
    return sorted(map(tuple, index.counts.select("k1", "k2", "refs", "least.doc_id").collect())), sorted(map(tuple, index.references.collect()))


def copies_are_exact(index):
    """Every key stands in its filter as often as its references say, at least."""
    for need, column in ((1, F.lit(True)), (2, F.col("refs") >= 2)):
        want = index.counts.filter(column).select("k1", "k2")
        assert index._ask(want, need).count() == want.count()


@pytest.mark.parametrize("keys_per_shard", [8, 100_000])
def test_insertions_and_deletions_are_reversible(spark, keys_per_shard):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    first, second, third = some_rows(2, 30), some_rows(3, 25, 100), some_rows(4, 10, -50)
    index = LineIndex(spark, keys_per_shard=keys_per_shard).insert(frame(first))
    start, entries = state(index), sum(CuckooFilter.from_bytes(r["filter"]).entries for r in index.filters.collect())
    index.insert(frame(second)).insert(frame(third))
    copies_are_exact(index)
    assert found(index.drop_repeated(frame(first + third))) == plain(first + third, first + second + third)
    index.delete(frame(third))  # the smallest holders go
    assert found(index.drop_repeated(frame(first + second))) == plain(first + second)
    index.delete(frame(second).select("doc_id"))
    copies_are_exact(index)
    assert state(index) == start
    assert sum(CuckooFilter.from_bytes(r["filter"]).entries for r in index.filters.collect()) == entries
    assert found(index.drop_repeated(frame(second))) == plain(second, first)
    index.insert(frame(first))  # known already: nothing changes
    assert state(index) == start
    index.delete(frame(first))
    assert index.counts.count() == index.references.count() == 0
    index.insert(frame(second))
    assert found(index.drop_repeated(frame(second))) == plain(second)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), unique=True, min_size=1, max_size=400), st.integers(0, 2**32))
def test_filter_has_no_false_no(keys, seed):
    rng = np.random.default_rng(seed)
    keys = np.array(keys, np.uint64)
    twice = keys[rng.random(len(keys)) < 0.5]
    made = CuckooFilter.of(np.r_[keys, twice])
    assert (made.copies(keys) >= 1).all() and (made.copies(twice) >= 2).all() and made.entries == len(keys) + len(twice)
    gone = rng.random(len(keys)) < 0.5
    again = CuckooFilter.from_bytes(made.to_bytes())
    again.remove(keys[gone])
    assert (again.copies(keys[~gone]) >= 1).all() and again.entries == made.entries - gone.sum()
    again.add(keys[gone])
    assert (again.copies(keys) >= 1).all() and (again.copies(twice) >= 2).all()


def test_filter_of_many_keys_and_its_false_yes():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**63, 200_000).astype(np.uint64)
    made = CuckooFilter.of(np.unique(keys))
    assert (made.copies(keys) >= 1).all()
    assert (made.copies(rng.integers(2**63, 2**64 - 1, 200_000, dtype=np.uint64)) >= 1).mean() < 0.001
    with pytest.raises(Full):
        small = CuckooFilter.sized(8)
        small.add(keys[:100])
    with pytest.raises(KeyError):
        CuckooFilter.sized(8).remove(keys[:1])
