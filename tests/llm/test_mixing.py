import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foretell.llm import mixing
from foretell.llm.mixing import mix, mixed_positions, schedule, whole_weights


def deviates(order, weights):
    """The largest deviation, in blocks, of the sources' shares from their exact targets over all slots."""
    whole = whole_weights(weights)
    total, had, worst = sum(whole), [0] * len(whole), Fraction(0)
    for t, i in enumerate(order, 1):
        had[i] += 1
        worst = max(worst, max(abs(n - Fraction(a * t, total)) for n, a in zip(had, whole)))
    return worst


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0.001, 100), min_size=1, max_size=12))
def test_no_source_deviates_by_a_block_from_its_exact_target(weights):
    blocks = [10**6] * len(weights)
    order = mixing.earliest_deadline_first([min(b, math.ceil(600 * w / sum(weights)) + 2) for b, w in zip(blocks, weights)], whole_weights(weights))
    assert deviates(order[:600], weights) < 1


def test_deviation_does_not_grow_with_the_length():
    """Targets that no small period holds, over 100,000 slots."""
    weights = [1 / 3, 0.21, 0.4563, 0.0003]
    share = [w / sum(weights) for w in weights]
    source, _ = schedule([math.ceil(100_000 * w) + 2 for w in share], weights)
    had = np.cumsum(source[:100_000, None] == np.arange(4), axis=0)
    assert np.abs(had - np.arange(1, 100_001)[:, None] * np.array(share)).max() < 1


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), st.floats(0, 5)), min_size=1, max_size=6))
def test_schedule_uses_every_block_once_and_restarts_when_a_source_ends(sources):
    blocks, weights = [n for n, _ in sources], [w for _, w in sources]
    source, block = schedule(blocks, weights)
    assert sorted(zip(source.tolist(), block.tolist())) == [(i, b) for i, n in enumerate(blocks) for b in range(n)]
    left, start = list(blocks), 0
    while start < len(source):  # each stretch with the same sources keeps to their exact targets
        active = [i for i, n in enumerate(left) if n]
        end = next((t for t in range(start, len(source)) if left[source[t]] - (source[start : t + 1] == source[t]).sum() == 0), len(source) - 1) + 1
        whole = whole_weights(weights)
        assert deviates([active.index(i) for i in source[start:end]], [whole[i] for i in active]) < 1
        for i in source[start:end]:
            left[i] -= 1
        start = end


@pytest.mark.parametrize("slots", [1 << 20, 200])
def test_mix_keeps_rows_and_weights(spark, slots):
    rows = [(n, f"text {n}", "a" if n % 3 else None if n % 2 else "b", "x") for n in range(3000)] + [(5, "text 5", "a", "x")] * 2 + [(None, None, "c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rank string")
    target = {"a": 0.5, "b": 0.25, None: 0.25}
    got = sorted(mixed_positions(docs, target, block=4, slots=slots).collect(), key=lambda r: r.position)
    assert len(got) == len(rows) and len({r.position for r in got}) == len(rows)
    turns = [source for _, source in sorted({(r.slot, r.source) for r in got}, key=lambda x: x[0])]
    names = sorted({*turns}, key=str)
    end = next(t for t, s in enumerate(turns) if s == "c")  # until the first source ends
    assert deviates([names.index(s) for s in turns[:end]], [target.get(s, 0.25) for s in names]) < 1
    out = mix(docs, target, block=4)
    assert out.columns == docs.columns
    mixed = [tuple(r) for r in out.collect()]
    assert sorted(mixed, key=str) == sorted(rows, key=str)
    place = {}
    for r in got:
        place.setdefault((r.doc_id, r.source), []).append(r.position)
    assert [place[m[0], m[2]].pop(0) for m in mixed] == sorted(r.position for r in got)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(i % 7, f"t{i}", f"s{i % 3}") for i in range(60)], "doc_id long, text string, source string")
    for name in ("_h", "_id", "_n", "_m", "_i", "text_hash", "number", "mixed_id", "mixed_position", "rank", "block", "slot", "a.b"):
        docs = docs.withColumn(name, F.lit(name))
    out = mix(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, docs.collect()))


def test_empty_table(spark):
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


@pytest.mark.parametrize("seed,warm", [(0, 0), (1, 3), (2, 64)])
def test_slices_yield_the_schedule_of_one_loop(spark, seed, warm):
    """Also where a slice does not fall in with the one before and all are run again from further back."""
    rng = np.random.default_rng(seed)
    blocks = [int(n) for n in rng.integers(1, 400, 12)] + [0, 1]
    weights = [float(w) for w in rng.random(12) ** 3 + 1e-3] + [0.5, 1e-4]
    source, block = schedule(blocks, weights)
    got = sorted((r.slot, r.source, r.block) for r in mixing.plan_slots(spark, blocks, weights, slots=300, warm=warm).collect())
    assert got == list(zip(range(len(source)), source.tolist(), block.tolist()))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(0.001, 100), min_size=1, max_size=40), st.integers(0, 5000))
def test_from_a_border_state_every_deadline_is_met(weights, t):
    whole = whole_weights(weights)
    had, total = mixing.border(whole, t), sum(whole)
    assert sum(had) == t and all(abs(n * total - w * t) < total for n, w in zip(had, whole))
    for k in range(1, 200):
        mixing.follow([10**9] * len(whole), whole, had, t + k - 1, 1)
        assert all(abs(n * total - w * (t + k)) < total for n, w in zip(had, whole))
