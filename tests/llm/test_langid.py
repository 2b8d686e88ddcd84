import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foretell.llm.langid import expected_counts, forward, identify, lattice, log_forward, n_pieces, piece_hash, pieces, word_scores
from foretell.llm.words import words_of


@pytest.fixture(scope="module")
def p():
    p = np.random.default_rng(0).random((n_pieces() + 1, 2)) ** 3
    p[-1] = 0
    return p / p.sum(axis=0)


def number(piece):
    keys, numbers = pieces()[len(piece)]
    at = np.searchsorted(keys, np.uint64(piece_hash(piece)))
    return numbers[at] if at < len(keys) and keys[at] == piece_hash(piece) else None


def segmentations(word):
    if not word:
        yield []
    for n in range(1, min(len(pieces()) - 1, len(word)) + 1):
        if number(word[:n]) is not None:
            for rest in segmentations(word[n:]):
                yield [number(word[:n]), *rest]


@pytest.mark.parametrize("word", [b" the", b" straf", " schön".encode(), b" a", b"\xff\xfe x"])
def test_sums_all_segmentations(p, word):
    each = [(s, np.prod(p[s], axis=0)) for s in segmentations(word)]
    total = sum(v for _, v in each)
    assert forward(lattice([word]), p)[0, -1] == pytest.approx(total)
    assert np.exp(log_forward([word], p)[0]) == pytest.approx(total)
    if word.startswith(b" ") and b" " not in word[1:]:
        want = np.zeros(len(p))
        for s, v in each:
            for k in s:
                want[k] += 3 * v[0] / total[0]
        assert expected_counts([word[1:]], np.array([3.0]), p[:, [0]]) == pytest.approx(want)


def test_all_pieces_are_used():
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    long = [t for i in range(model.get_piece_size()) if len(t := model.id_to_piece(i).replace("▁", " ").encode()) > 8 and b" " not in t[1:] and not model.is_control(i)]
    assert len(long) > 1000 and all(number(t) is not None for t in long[:200])


def test_long_words_are_summed_whole(p):
    """Logs of a plain forward pass over the whole word, pieces across every border included."""
    rng = np.random.default_rng(3)
    word = b" " + bytes(rng.choice(list(b"abetrsiong"), 700).tolist())
    alpha = [1.0] + [0.0] * len(word)
    scale = 0.0
    for j in range(1, len(word) + 1):
        for n in range(1, min(len(pieces()) - 1, j) + 1):
            k = number(word[j - n : j])
            if k is not None:
                alpha[j] += alpha[j - n] * p[k, 0]
        if j % 10 == 0:
            scale += math.log(alpha[j])
            alpha[max(0, j - 60) : j + 1] = [a / alpha[j] for a in alpha[max(0, j - 60) : j + 1]]
    assert word_scores([word[1:]], p)[0, 0] == pytest.approx(scale + math.log(alpha[-1]))


def test_long_words_do_not_underflow(p):
    word = b"xq" * 100_000
    assert all(math.isfinite(x) for x in word_scores([word], p)[0])


@pytest.mark.parametrize("length", [15, 16, 17, 99, 255, 256, 300, 700])
def test_expected_counts_of_long_words_sum_all_segmentations(p, length):
    """Against plain forward and backward sums in logs, over the whole word."""
    word = b" " + bytes(np.random.default_rng(length).choice(list(b"abetrsiong"), length).tolist())
    log_p, places = np.log(p[:-1, 0]), len(word)
    found = [[(i, number(word[i:j])) for i in range(max(0, j - len(pieces()) + 1), j) if number(word[i:j]) is not None] for j in range(places + 1)]
    ahead, behind = np.full(places + 1, -np.inf), np.full(places + 1, -np.inf)
    ahead[0] = behind[-1] = 0
    for j in range(1, places + 1):
        ahead[j] = np.logaddexp.reduce([ahead[i] + log_p[k] for i, k in found[j]])
    for j in range(places, 0, -1):
        for i, k in found[j]:
            behind[i] = np.logaddexp(behind[i], behind[j] + log_p[k])
    want = np.zeros(len(p))
    for j in range(1, places + 1):
        for i, k in found[j]:
            want[k] += 2 * math.exp(ahead[i] + log_p[k] + behind[j] - ahead[-1])
    got = expected_counts([word[1:], word[1:]], np.array([0.5, 1.5]), p[:, [0]])
    assert got == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_signs_part_words():
    assert words_of("Ça va。好的\u3000ja—nein «oui» x²") == ["ça".encode(), b"va", "好的".encode(), b"ja", b"nein", b"oui", b"x"]


def test_held_out_and_edge_cases(spark):
    words = {"aa": "the house under morning water reading", "bb": "der haus unter morgen wasser lesen", "cc": "la maison sous matin eau lire"}
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(words[k].split(), 12)), k, "en") for i, k in enumerate(["aa", "bb", "cc"] * 40)]
    rows += [(900, None, "aa", "x"), (901, " 12 \n!", "bb", "x"), (902, "", None, "x"), (903, "morgen " * 3000, None, "x"), (904, "Wasser WASSER", "aa", None)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in identify(docs, (F.col("doc_id") % 4 != 0) & (F.col("doc_id") < 900), sample=30).collect()}
    assert all(got[i].lang_pred == k for i, _, k, _ in rows[:120])
    assert [got[i].lang_pred for i in (900, 901, 902, 903, 904)] == ["und", "und", "und", "bb", "bb"]
    assert got[900].score == 0 and all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in identify(docs, F.lit(False)).collect()} == {"und"}
    assert identify(docs.limit(0), F.lit(True)).count() == 0
