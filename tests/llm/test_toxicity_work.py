"""The scorer's work per text does not grow with the words met before it."""

import numpy as np

from foretell.llm.toxicity import WINDOW, Network, Scorer, starts, trigrams, trigrams_of, windows


def test_the_table_of_words_is_seldom_copied():
    scorer, tables, scores = Scorer(Network()), [], []
    docs = [[b"w%d" % (k * 20 + i) for i in range(40)] for k in range(200)]
    for words in docs:
        scores.append(scorer.largest([words])[0])
        if not any(scorer.gates["f"] is x for x in tables):
            tables.append(scorer.gates["f"])
    assert len(scorer.at) == 4020 and len(tables) <= 9
    assert np.abs(np.array(scores) - Scorer(Network()).largest(docs)).max() < 1e-6


def test_trigrams_of_many_words_are_those_of_each():
    words = [b"a", b"hello", "größe".encode(), b"", b"x" * 64]
    flat, n = trigrams_of(words)
    assert flat.tolist() == [t for w in words for t in trigrams(w)] and n.tolist() == [len(trigrams(w)) for w in words]


def test_windows_of_documents_of_any_length():
    docs = [list(range(k, k + n)) for k, n in enumerate([0, 1, 16, 17, 32, 33, 0, 48, 49, 300, 0])]
    numbers, owner = windows(docs)
    want = [(d, (words[s : s + WINDOW] + [-1] * WINDOW)[:WINDOW]) for d, words in enumerate(docs) for s in starts(len(words))]
    assert owner.tolist() == [d for d, _ in want] and numbers.tolist() == [w for _, w in want]
    assert windows([])[0].shape == (0, WINDOW)
