import json
import random

import pytest

from foretell.operators.search_index import SearchIndex
from foretell.sources import readers, snapshots


def chain(spark, path, pages, start, limit=None):
    spark.createDataFrame([(c, n, json.dumps([{"id": i} for i in items])) for c, n, items in pages], "cursor string, next_cursor string, items string").write.json(path)
    return sorted((r.page, r.id) for r in readers.cursor_pages(spark, path, start, limit).collect())


@pytest.mark.parametrize("n", [1, 2, 3, 8, 37])
def test_chains_of_any_length(spark, tmp_path, n):
    pages = [(f"c{k}", f"c{k + 1}" if k < n - 1 else None, [f"{k}a", f"{k}b"]) for k in range(n)]
    lost = [("x", "c0", ["lost"]), ("y", "c1", ["lost"]), ("z", None, ["lost"])]
    random.Random(n).shuffle(pages)
    want = sorted((k, f"{k}{s}") for k in range(n) for s in "ab")
    assert chain(spark, str(tmp_path / "p"), pages + lost, "c0") == want
    assert chain(spark, str(tmp_path / "q"), pages + lost, "c0", limit=3) == [w for w in want if w[0] < 3]


def test_a_chain_that_runs_into_itself_ends_there(spark, tmp_path):
    pages = [("a", "b", ["1"]), ("b", "c", ["2"]), ("c", "b", ["3"])]
    assert chain(spark, str(tmp_path / "p"), pages, "a") == [(0, "1"), (1, "2"), (2, "3")]
    assert chain(spark, str(tmp_path / "q"), pages, "none") == []


def plain_versions(tables):
    """Every version's rows, and the changes from one to the next."""
    out = []
    for v, (a, b) in enumerate(zip([{}, *tables], tables), 1):
        for k in sorted({*a, *b}):
            if k not in a or k not in b:
                out.append((k, v, "added" if k in b else "removed", None, None, None))
                continue
            for c in sorted({*a[k], *b[k]}):
                x, y = a[k].get(c), b[k].get(c)
                if x != y:
                    out.append((k, v, "changed", c, None if x is None else str(x), None if y is None else str(y)))
    return sorted(out, key=str)


def test_snapshots_read_back_and_change_events(spark, tmp_path):
    rng = random.Random(2)
    row = lambda: {"v": rng.choice([None, 1, 2]), "s": rng.choice(["x", "y", None])}
    tables = [{k: row() for k in rng.sample(range(40), 25)} for _ in range(3)]
    tables.append(dict(tables[-1]))  # nothing changes
    tables.append({k: r | {"more": "new"} for k, r in tables[-1].items()})
    kept = snapshots.Snapshots(spark, str(tmp_path), "k")
    assert kept.versions() == 0
    for n, t in enumerate(tables, 1):
        more = ", more string" if n == 5 else ""
        rows = [(k, r["v"], r["s"], *([r["more"]] if more else [])) for k, r in t.items()]
        assert kept.save(spark.createDataFrame(rows, f"k int, v int, s string{more}")) == n
    for n, t in enumerate(tables, 1):
        assert {r.k: (r.v, r.s, r.more) for r in kept.read(n).collect()} == {k: (r["v"], r["s"], r.get("more")) for k, r in t.items()}
    got = [tuple(r) for r in kept.events(0, 5).select("k", "version", "change", "column", "old", "new").collect()]
    assert sorted(got, key=str) == plain_versions(tables)
    assert spark.read.parquet(f"{tmp_path}/opened/version=4").count() == 0


def test_a_version_without_its_pointer_does_not_count(spark, tmp_path):
    kept = snapshots.Snapshots(spark, str(tmp_path), "k")
    kept.save(spark.createDataFrame([(1, "a")], "k int, s string"))
    spark.createDataFrame([(2, "half")], "k int, s string").write.parquet(f"{tmp_path}/opened/version=2")  # a writer that failed half way
    assert [tuple(r) for r in kept.read().collect()] == [(1, "a")]
    assert kept.save(spark.createDataFrame([(1, "b")], "k int, s string")) == 2
    assert [tuple(r) for r in kept.read().collect()] == [(1, "b")]


@pytest.mark.parametrize("block", [7, 10_000])
def test_search_index_like_substrings(spark, tmp_path, block):
    rng = random.Random(block)
    words = ["Senate", "senator", "Ohio", "ohm", "ab", "New Mexico", "über", "x", "governor-race", "2026"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 4))) or None, rng.choice(words + [None])) for i in range(120)]
    index = SearchIndex.build(spark.createDataFrame(rows, "id int, a string, b string"), "id", ["a", "b"], str(tmp_path / "i"), block)
    low = {i: ((a or "").lower(), (b or "").lower()) for i, a, b in rows}
    for q in ["senat", "OHIO 2026", "new mex", "ab", "x", "", "über sen", "none", "mexico ov race"]:
        hay = {i: " ".join(f) for i, f in low.items()}
        assert sorted(r.id for r in index.all_words(q).collect()) == sorted(i for i, h in hay.items() if all(w in h for w in q.lower().split()))
        assert sorted(r.id for r in index.phrase(q).collect()) == sorted(i for i, f in low.items() if any(q.lower() in x for x in f))


def test_only_the_folders_asked_for_are_read(spark, tmp_path):
    index = SearchIndex.build(spark.createDataFrame([(i, f"word{i} number") for i in range(50)], "id int, a string"), "id", ["a"], str(tmp_path / "i"))
    plan = index.postings(["wor", "ord"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [folder" in plan.replace("isnotnull(folder", "[folder") or "folder" in plan.split("PartitionFilters")[1][:200]
    assert {r.gram for r in index.postings(["wor", "ord", "zzz"]).collect()} == {"wor", "ord"}
