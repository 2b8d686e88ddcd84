import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from foretell.llm.simhash import BLOCKS, bucket_links, drop_near_duplicates, fingerprint, links, near_duplicate_texts, near_duplicates


def plain_fingerprint(text, words=4):
    parts = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    parts = [w for w in __import__("re").split("[\x20\x09-\x0d]+", parts) if w]
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


TEXTS = ["", None, " \t\n", "one", "one two three", "One  TWO three", "É a b c d e", "a b c d " * 400, "a b c d e f g h i j k", "A b c d e f g h i j l"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def test_blocks_cover_all_bits():
    assert [b for first, width in BLOCKS for b in range(first, first + width)] == list(range(64))


@pytest.mark.parametrize("tile", [8192, 40])
def test_links_connect_like_all_pairs(spark, tile):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**64, 30, dtype=np.uint64)
    fps = {int(c) for c in centres}
    for c in centres[:6]:
        for _ in range(60):
            x = int(c)
            for b in rng.integers(0, 64, int(rng.integers(1, 6))):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    out = links(spark.createDataFrame([(i, x, x) for i, x in enumerate(signed)], "id long, hash long, fp long"), 4, tile).collect()
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for u, v in out:
        assert bin(fps[u.id] ^ fps[v.id]).count("1") <= 4
        a, b = find(u.id), find(v.id)
        label[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(fps))] == plain_components(fps)


def test_components_and_edge_cases(spark):
    base = " ".join(f"w{i}" for i in range(300))
    texts = TEXTS + [base, base + " x", base.replace("w150", "q"), "z " + base]
    rows = [(i * 7 % 101, t, 1) for i, t in enumerate(texts)] + [(500, base, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int").withColumn("component_id", F.lit("x"))
    got = {r.doc_id: r for r in near_duplicates(docs).collect()}
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    comps = plain_components(fps)
    for (doc_id, _, _), fp, c in zip(rows, fps, comps):
        members = [rows[k][0] for k in range(len(rows)) if comps[k] == c]
        assert got[doc_id].fp % 2**64 == fp
        assert got[doc_id].component_id == min(members)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_wide_links_catch_near_copies_and_leave_others(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, groups = [], {}
    for g in range(60):
        base = list(rng.choice(vocabulary, int(rng.integers(40, 400))))
        for c in range(3):
            text = list(base)
            for at in rng.choice(len(text), max(1, len(text) // 90), replace=False) if c else []:
                text[at] = "changed"
            groups[len(rows)] = g
            rows.append((len(rows), " ".join(text), c))
    rows += [(1000, "", 0), (1001, None, 0), (1002, "one", 0), (1003, "two words", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    shingles = {i: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t, _ in rows if i in groups}
    got = {r.doc_id: r.component_id for r in near_duplicate_texts(docs).collect()}
    close = [(a, b) for a in groups for b in groups if a < b and len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])]
    assert len(close) > 60
    assert sum(got[a] == got[b] for a, b in close) >= 0.99 * len(close)
    assert all(groups[got[i]] == g for i, g in groups.items())
    assert got[1000] == got[1001] == 1000 and got[1002] == 1002 and got[1003] == 1003
    left = drop_near_duplicates(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == set(got.values())
    assert drop_near_duplicates(docs.limit(0)).count() == 0


def test_a_repeated_line_does_not_link_different_documents(spark):
    rng = np.random.default_rng(5)
    line = " ".join(f"menu{i}" for i in range(8)) + " "
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 5000, 200)) + " " + line * 60 for _ in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in drop_near_duplicates(docs).collect()} == {0, 1}


def exact_components(sets, similarity=0.8):
    label = list(range(len(sets)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    close = []
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                close.append((j, i))
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))], close


@pytest.mark.parametrize("tile", [8192, 30])
def test_similar_components_are_those_of_the_exact_similarity(spark, tile, monkeypatch):
    """Pairs from far below to far above 0.8, a group in which all share much, and buckets beyond a tile."""
    from foretell.llm import simhash

    monkeypatch.setattr(simhash.similar_components, "__defaults__", (tile,))
    rng = np.random.default_rng(12)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts = []
    for g in range(40):
        base = list(rng.choice(vocabulary, int(rng.integers(60, 300))))
        for c in range(int(rng.integers(2, 6))):
            text = list(base)
            for at in rng.choice(len(text), int(rng.integers(0, max(2, len(text) // 25))), replace=False):
                text[at] = f"new{rng.integers(1000)}"
            texts.append(" ".join(text))
    hot = list(rng.choice(vocabulary, 150))
    for c in range(120):
        text = list(hot)
        for at in rng.choice(150, int(rng.integers(0, 5)), replace=False):
            text[at] = f"hot{c}"
        texts.append(" ".join(text))
    texts += [" ".join(rng.choice(vocabulary, 80)) for _ in range(40)]
    texts = list(dict.fromkeys(texts))
    words = [t.split() for t in texts]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in words]
    want, close = exact_components(sets)
    got = {r.doc_id: r.component_id for r in near_duplicate_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(got[a] == got[b] for a, b in close) >= 0.99 * len(close)
    assert all(want[got[i]] == want[i] for i in got)  # nothing is linked that the exact similarity does not link


def test_forests_span_and_are_never_all_pairs():
    fps = np.zeros((500, 1), np.uint64)
    fps[:, 0] = np.arange(500) % 4
    keys = np.repeat([1, 2, 3], [3, 12, 485])
    u, v = bucket_links(keys, fps, np.arange(500), 4)
    assert len(u) == 500 - 3 and (keys[u] == keys[v]).all()
    u, v = bucket_links(keys, fps, keys, 4)  # connected already
    assert len(u) == 0


def test_clashing_columns_and_repeated_ids(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(1, base, 0), (1, "another text altogether", 0), (2, base + " x", 0), (2, "x y z", 0), (None, base + " y", 0), (3, "", 0), (4, None, 0), (1, base, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, z int")
    for name in ("_id", "id", "hash", "_hash", "label", "node", "keys", "fp", "tiles", "component_id", "u", "v"):
        docs = docs.withColumn(name, F.lit(name))
    left = drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(1, "another text altogether"), (1, base), (2, "x y z"), (3, "")]
    assert near_duplicates(docs).count() == len(rows) and near_duplicate_texts(docs).count() == len(rows)
