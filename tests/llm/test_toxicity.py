import numpy as np
import pytest
from pyspark.sql import functions as F

from foretell.llm.toxicity import LONG, STRIDE, WINDOW, Network, Scorer, Words, parts_of, score, starts, trigrams, windows
from foretell.llm.words import words_of


def test_gradient():
    rng = np.random.default_rng(0)
    words = Words([b"hello", b"ab", b"worthless", b"x", b"the", b"house"])
    numbers = rng.integers(0, 6, (4, WINDOW))
    numbers[0, 10:] = numbers[2, 1:] = -1
    labels = np.array([1.0, 0, 1, 0])
    network = Network(kind=np.float64)
    _, g = network.gradient(words, numbers, labels)
    for k, v in network.p.items():
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        old, e = v[at], 1e-5
        v[at] = old + e
        up = network.gradient(words, numbers, labels)[0]
        v[at] = old - e
        down = network.gradient(words, numbers, labels)[0]
        v[at] = old
        assert g[k][at] == pytest.approx((up - down) / 2 / e, rel=1e-4, abs=1e-9)


@pytest.mark.parametrize("n", [0, 1, STRIDE, WINDOW, WINDOW + 1, 200])
def test_windows_cover_every_word_and_overlap(n):
    numbers, owner = windows([list(range(n))])
    assert {int(x) for x in numbers.ravel() if x >= 0} == set(range(n))
    assert len(owner) == len(starts(n))
    assert all(b - a == STRIDE for a, b in zip(starts(n), list(starts(n))[1:]))


def test_every_byte_of_a_long_word_is_read():
    word = "abcdefghijklmnopqrstuvwxyz" * 40
    parts = parts_of(word)
    assert max(map(len, parts)) <= LONG and {t for w in parts for t in trigrams(w)} >= set(trigrams(word.encode()))
    assert parts_of("short one") == [b"short", b"one"] and parts_of("x" * LONG) == [b"x" * LONG] and parts_of(None) == []


def test_scorer_equals_scoring_each_window_alone():
    rng = np.random.default_rng(2)
    docs = [[rng.choice([b"one", b"two", b"three", b"four"]) for _ in range(n)] for n in (1, 40, 100)]
    scorer = Scorer(Network())
    got = scorer.largest(docs, lot=3)
    want = [max(scorer.largest([[bytes(w) for w in d[s : s + WINDOW]]])[0] for s in starts(len(d))) for d in docs]
    assert got == pytest.approx(want, abs=1e-5)


def test_held_out_accuracy_and_edge_cases(spark):
    rng = np.random.default_rng(3)
    plain = "house garden river stone letter morning window paper winter bread".split()
    rows, labels = [], []
    for i in range(400):
        words = list(rng.choice(plain, int(rng.integers(5, 120))))
        if i % 4 == 0:
            for _ in range(3):
                words.insert(int(rng.integers(0, len(words))), "vexq" + str(rng.choice(["ing", "ous", "er", "ible"])))
        rows.append((i, " ".join(words), "en"))
        labels.append((i, int(i % 4 == 0), "x"))
    rows += [(900, None, "en"), (901, "", "en"), (902, "12 !", None), (903, "garden " * 5000 + "vexqing", "en")]
    labels += [(900, 1, "x"), (903, None, "x")]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id long, text string, score string")
    table = spark.createDataFrame(labels + labels[:3], "doc_id long, toxic int, text string")
    learn = F.col("doc_id") % 5 != 0
    got = {r.doc_id: r.score for r in score(docs, table, learn).collect()}
    held = [i for i in range(0, 400, 5)]
    assert np.mean([(got[i] >= 0.3) == (i % 4 == 0) for i in held]) > 0.9
    assert got[900] == got[901] == got[902] == 0 and got[903] >= 0.3 and all(0 <= s <= 1 for s in got.values())
    assert {r.score for r in score(docs, table.limit(0), learn).collect()} == {0.0}
    assert score(docs.limit(0), table, learn).count() == 0
    assert words_of("Ab-Cé 1x") == [b"ab", "cé".encode(), b"x"]


@pytest.mark.parametrize(
    "texts,toxic",
    [
        (["12 !"] * 6, [0, 1] * 3),
        (["vile words", "", "fine words", " ", "vile thing", "12"], [1, 0, 0, 0, 1, 0]),
        (["vile words", "fine words"], [1, 0]),
        (["fine words"] * 8, [0] * 8),
        (["vile words", None], [1, 0]),
    ],
)
def test_blank_and_few_texts_score_between_0_and_1(spark, texts, toxic):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    got = [r.score for r in score(docs, labels, F.lit(True), steps=5).collect()]
    assert len(got) == len(texts) and all(0 <= s <= 1 for s in got)


def test_clashing_labels_and_texts_are_settled(spark):
    rows = [(i, f"{w} words here", w == "vile") for i, w in enumerate(["vile", "fine"] * 20)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(i, "another text") for i in range(0, 40, 3)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(v)) for i, _, v in rows] + [(i, 0) for i in range(0, 40, 4)], "doc_id long, toxic int")
    one = sorted(map(tuple, score(docs, labels, F.lit(True), steps=5).collect()))
    assert one == sorted(map(tuple, score(docs.repartition(7), labels.repartition(3), F.lit(True), steps=5).collect()))
