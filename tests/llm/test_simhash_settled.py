"""Buckets with links that fail are read once more, and every pair of them that is similar ends up connected."""

import random

import numpy as np
import pytest

from foretell.llm import simhash


def straddling(members, seed):
    """Texts about one base, whose similarities lie about 0.8."""
    draw = random.Random(seed)
    base = [f"w{draw.randrange(10**6)}" for _ in range(200)]
    for _ in range(members):
        words = list(base)
        for at in draw.sample(range(200), draw.randrange(1, 9)):
            words[at] = f"v{draw.randrange(10**6)}"
        yield " ".join(words)


@pytest.mark.parametrize("tile,load", [(8192, 1 << 25), (40, 1 << 25), (8192, 1 << 15)])
def test_no_similar_pair_of_a_bucket_is_left_apart(spark, monkeypatch, tile, load):
    monkeypatch.setattr(simhash.similar_components, "__defaults__", (tile,))
    monkeypatch.setattr(simhash, "LOAD", load, raising=False)
    texts = [t for seed in range(3) for t in straddling(90, seed)]
    reads, real = [], simhash._found
    monkeypatch.setattr(simhash, "_found", lambda *args: reads.append(1) or real(*args))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(reads) <= 2
    sets = [np.unique((np.unique(simhash.shingle_hashes(t.encode(), 5)) >> np.uint64(32)).astype("<u4")) for t in texts]
    keys = [set(simhash.bucket_keys(s).tolist()) for s in sets]
    close = [(i, j) for i in range(270) for j in range(i) if keys[i] & keys[j] and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
    assert len(close) > 1000 and all(got[i] == got[j] for i, j in close)


def test_settled_links_connect_like_all_pairs():
    rng = np.random.default_rng(4)
    for n in (2, 3, 17, 60):
        sets = [np.unique(rng.choice(40, 30)).astype("<u4") for _ in range(n)]
        fps, label = rng.integers(0, 4, (n, simhash.LANES)).astype(np.uint64), rng.integers(0, n // 2 + 1, n)
        joined = [(i, j) for i in range(n) for j in range(i) if label[i] == label[j]]
        near = {(i, j) for i in range(n) for j in range(i) if simhash.distance(fps[i], fps[j]) <= 5 and len(np.intersect1d(sets[i], sets[j])) >= 0.6 * len(np.union1d(sets[i], sets[j]))}
        u, v = simhash.settled_links(fps, label, sets, 5, 0.6)
        told = {(max(a, b), min(a, b)) for a, b in zip(u.tolist(), v.tolist())}
        assert told <= near and len(told) < n
        assert parts(n, [*joined, *told]) == parts(n, [*joined, *near])


def parts(n, pairs):
    label = list(range(n))
    for a, b in pairs:
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = [new if x == old else x for x in label]
    return label
