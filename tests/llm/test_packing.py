import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from foretell.llm.packing import CAPACITY, cuts, pack_documents, plan, tokenise


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def best_fit_decreasing(counts, capacity):
    gaps = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [g for g in gaps if g >= length]
            if fits:
                gaps.remove(min(fits))
                gaps.append(min(fits) - length)
            else:
                gaps.append(capacity - length)
    return len(gaps)


@pytest.mark.parametrize("seed", range(40))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    counts = {22: 17, 43: 15} if not seed else {n: rng.randint(1, 40) for n in rng.sample(range(1, 65), rng.randint(1, 30))}
    rows = plan(counts, 64)
    bins = defaultdict(list)
    ranks = defaultdict(list)
    for length, first, count, sequence, offset in rows:
        ranks[length] += range(first, first + count)
        for k in range(count):
            bins[sequence + k].append((offset, length))
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
    assert sorted(bins) == list(range(len(bins)))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= best_fit_decreasing(counts, 64) + 1


def test_cuts():
    assert cuts(3, 4) == [0, 3] and cuts(4, 4) == [0, 4] and cuts(9, 4) == [0, 1, 5, 9] and cuts(8, 4) == [0, 4, 8]


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["", None, "a", "<|endoftext|> said </s>", "wörter und 日本 🙂 " * 700, "the cat sat " * 2000, "x" * 5000, " \n\t "] + [f"number {i} " * (i % 90) for i in range(200)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(2, "a", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, length int")


def test_ids_equal_the_tokenizer(docs):
    t = library()
    got = defaultdict(list)
    for r in tokenise(docs.filter("doc_id <> 2")).orderBy("doc_id", "piece").collect():
        assert r.start == len(got[r.doc_id]) and r.length == len(r.ids) <= CAPACITY
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        got[r.doc_id] += r.ids
    for r in docs.filter("doc_id <> 2").collect():
        assert got[r.doc_id] == [*t.encode(r.text or "", add_special_tokens=False).ids, 2]


def test_sequences_are_gapless_and_few(docs):
    rows = pack_documents(docs).collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= CAPACITY
    total = sum(r.length for r in rows)
    assert len(bins) <= -(-total // CAPACITY) + 2
    assert sum(r.doc_id == 2 for r in rows) == 2


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "ab" * 500_000, "-" * 1_000_000])
def test_very_long_runs(spark, text):
    rows = pack_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert sum(r.length for r in rows) == len(library().encode(text, add_special_tokens=False).ids) + 1
    assert len({r.sequence_id for r in rows}) == len(rows)


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_many_runs_of_blanks_just_below_the_limit_are_quick():
    import time

    from foretell.llm.packing import LONG_RUN, encoder

    encode = encoder()
    began = time.perf_counter()
    assert len(encode(("x" + " " * (LONG_RUN - 1)) * 200)) > 200
    assert time.perf_counter() - began < 10
