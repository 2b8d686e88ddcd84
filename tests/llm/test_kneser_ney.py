import math
import random
from collections import Counter, defaultdict

import pytest

from foretell.llm.kneser_ney import WIDTHS, Model, Symbols, fit, judge, keep_good, perplexities, perplexity


def plain_model(texts, order):
    start = "\x01"
    tables = {order: Counter()}
    for t in texts:
        p = start * (order - 1) + t
        tables[order].update(p[i : i + order] for i in range(len(t)))
    for n in range(order - 1, 0, -1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])
    discounts = {}
    for n, table in tables.items():
        have = Counter(table.values())
        y = have[1] / (have[1] + 2 * have[2]) if have[1] + 2 * have[2] else None
        d = {}
        for k in (1, 2, 3):
            v = k - (k + 1) * y * have[k + 1] / have[k] if y is not None and have[k] else 0.5 * k
            d[k] = max(0.0, min(float(k), v))
        discounts[n] = d

    def p(gram):
        n = len(gram)
        lower = p(gram[1:]) if n > 1 else 1 / (len(tables[1]) + 1)
        follow = {g: c for g, c in tables[n].items() if g[:-1] == gram[:-1]}
        if not follow:
            return lower
        total = sum(follow.values())
        off = {g: min(c, discounts[n][min(c, 3)]) for g, c in follow.items()}
        return (follow[gram] - off[gram] if gram in follow else 0.0) / total + sum(off.values()) / total * lower

    return lambda t: math.exp(-sum(math.log(p((start * (order - 1) + t)[i : i + order])) for i in range(len(t))) / len(t))


@pytest.mark.parametrize("most", [4_000_000, 0])
def test_perplexity_like_plain_model(spark, most):
    rng = random.Random(5)
    say = lambda n: "".join(rng.choice("aab bcé日") for _ in range(n))
    train = [(i, lang, say(60), 1) for i, lang in enumerate(["x", "y", None] * 8)]
    model = Model(spark.createDataFrame(train, "doc_id long, lang string, text string, c int"), order=3)
    rows = [(100 + i, lang, t, 1) for i, (lang, t) in enumerate([("x", say(40)), ("y", say(5)), (None, "zzz"), ("x", ""), ("x", None), ("new", "abc"), ("y", say(3000))])]
    got = {r.doc_id: r for r in perplexity(spark.createDataFrame(rows + rows[:1], "doc_id long, lang string, text string, gram int"), model, most).collect()}
    by = defaultdict(list)
    for _, lang, t, _ in train:
        by[lang].append(t)
    for i, lang, t, _ in rows:
        assert got[i].lang == lang
        if t and lang in by:
            assert got[i].perplexity == pytest.approx(plain_model(by[lang], 3)(t), rel=1e-9)
        else:
            assert got[i].perplexity is None


def test_junk_goes_and_clean_stays(spark):
    rng = random.Random(2)
    words = "the of and reading water house under morning letter garden people".split()
    clean = [(i, "en", " ".join(rng.choice(words) for _ in range(60)), "s") for i in range(300)]
    junk = [(1000 + i, "en", " ".join(rng.choice(words).upper() + "%%%" for _ in range(60)), "s") for i in range(20)]
    odd = [(2000, "en", "", "s"), (2001, None, None, "s"), (2002, "xx", "unknown language", "s")]
    docs = spark.createDataFrame(clean + junk + odd, "doc_id long, lang string, text string, low string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 300, 2)] + [(1000, 0), (4, 1)], "doc_id long, quality int")
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {i for i, *_ in junk} and {2000, 2001, 2002} <= ids
    assert len(ids & {i for i, *_ in clean}) >= 295
    assert judge(docs, labels.limit(0)).filter("rejected").count() == 0
    assert keep_good(docs.limit(0), labels).count() == 0


def test_every_code_point_is_a_symbol_of_its_own(spark):
    """Texts of some 9,000 different signs, held against a plain model of the order of their width."""
    rng = random.Random(7)
    signs = [chr(0x4E00 + k) for k in range(9000)]
    many = [(i, "zz", "".join(rng.choice(signs) for _ in range(900)) + "".join(signs[i * 300 : i * 300 + 300])) for i in range(30)]
    few = [(100 + i, "aa", "".join(rng.choice("abc ") for _ in range(50))) for i in range(5)]
    models = fit(spark.createDataFrame(many + few, "doc_id long, lang string, text string"))
    assert [m.order for m in models] == [5, 4]
    asked = [(1, "zz", many[0][2][:6]), (2, "aa", "abca"), (3, "zz", "一🙂㐀"), (4, "other", "x"), (5, None, "x")]
    got = {r.doc_id: r.perplexity for r in perplexities(spark.createDataFrame(asked, "doc_id long, lang string, text string"), models).collect()}
    assert got[1] == pytest.approx(plain_model([t for *_, t in many], 4)(asked[0][2]), rel=1e-9)
    assert got[3] == pytest.approx(plain_model([t for *_, t in many], 4)(asked[2][2]), rel=1e-9)
    assert got[2] == pytest.approx(plain_model([t for *_, t in few], 5)("abca"), rel=1e-9)
    assert got[4] is None and got[5] is None


def test_widths_hold_every_code_point():
    assert all(bits * order <= 63 for bits, order in WIDTHS) and 1 << WIDTHS[-1][0] > 0x110000 + 2
    with pytest.raises(ValueError):
        Symbols({"x": list(range(4095))}, 5, 12)


@pytest.mark.parametrize("most", [4_000_000, 0])
def test_ids_of_any_size_stay_as_they_are_next_to_a_null(spark, most):
    big = 2**60
    rows = [(None, "en", "some words"), (big + 1, "en", "some words"), (big, "en", "other words"), (-big - 1, "en", None)]
    model = Model(spark.createDataFrame([(1, "en", "some other words here")], "doc_id long, lang string, text string"))
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").coalesce(1)
    assert sorted((r.doc_id for r in perplexity(docs, model, most).collect()), key=str) == sorted((r[0] for r in rows), key=str)


def test_a_rejected_row_goes_next_to_a_null_id(spark):
    rng = random.Random(3)
    words = "the of and reading water house under morning letter garden people".split()
    say = lambda: " ".join(rng.choice(words) for _ in range(60))
    big = 2**60
    rows = [(i, "en", say()) for i in range(100)] + [(None, "en", say()), (big + 1, "en", "%%% QQQ " * 40), (big, "en", say())]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").coalesce(1)
    kept = {r.doc_id for r in keep_good(docs, spark.createDataFrame([(i, 1) for i in range(0, 100, 2)], "doc_id long, quality int")).collect()}
    assert big + 1 not in kept and {None, big} <= kept
