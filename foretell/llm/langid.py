"""Language identification by segmentation-marginalised unigrams (operator 2).

A language is a distribution over the pieces of a fixed public vocabulary (a sentencepiece model with byte fallback).  The probability of a word is the sum over all its segmentations into pieces, by the forward algorithm, rescaled every few places so that words of any length are summed whole; a text's is the product over its words.  Words are runs of letters (see `words.py`): digits and punctuation tell languages apart little and are left out.  Piece probabilities are learned by expectation-maximisation on word counts: forward-backward gives each piece's expected count over all segmentations.

Training may use a bounded sample: of every language the `sample` labelled documents whose hashed id is smallest, whole.  Word counts and expected counts are summed by Spark; the driver holds the pieces-by-languages table only (the vocabulary's size times the number of labels).  Words are counted whole, whatever their length.

Scoring runs where the documents are read, without a shuffle.  Words are scored once per worker and kept in a table of bounded size.  All pieces of the vocabulary are used, found by a polynomial hash of 64 bits that no two of them share.

Defined cases: null texts and texts without a letter are `und` with score 0; whole texts are read; ties go to the language that sorts first; rows with a null label are not learned from; repeated rows give repeated results; other columns are ignored; an empty table gives an empty result; without a labelled row every text is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretell.llm.common import bounded_sample, materialise, small_side
from foretell.llm.words import has_letter, words_of

VOCABULARY = "piece_bpe_32k.model"
SAMPLE, ROUNDS = 500, 3
#: Scores that a worker keeps.
KNOWN_SCORES = 1_600_000
#: Places scored at once, and places between rescalings.
SPAN, RESCALE = 256, 16
#: Base of the polynomial hash of pieces.
BASE = 0x9E3779B97F4A7C15
#: Added to every expected count, so that no piece is impossible.
PRIOR = 0.01


@lru_cache(maxsize=1)
def pieces(vocabulary: str = VOCABULARY) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length in bytes, the packed pieces in ascending order and their numbers."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary))
    texts = {bytes([b]) for b in range(256)}
    texts |= {model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    texts = {t for t in texts if t and b" " not in t[1:]}
    by_length: list[list[int]] = [[] for _ in range(max(map(len, texts)) + 1)]
    for t in texts:
        by_length[len(t)].append(piece_hash(t))
    out, first = [], 0
    for keys in by_length:
        if len(set(keys)) < len(keys):
            raise AssertionError("two pieces of a length share a hash")
        out.append((np.array(sorted(keys), np.uint64), np.arange(first, first + len(keys))))
        first += len(keys)
    return out


def piece_hash(piece: bytes) -> int:
    h = 0
    for b in piece:
        h = (h * BASE + b + 1) % 2**64
    return h


def n_pieces() -> int:
    return sum(len(keys) for keys, _ in pieces())


def lattice(words: list[bytes]) -> list[np.ndarray]:
    """For words of one length: per piece length, the piece (or -1) that ends at each place."""
    return _lattice(np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1))


def _lattice(codes: np.ndarray) -> list[np.ndarray]:
    codes = codes.astype(np.uint64) + np.uint64(1)
    key, out = np.zeros_like(codes), []
    for length, (keys, numbers) in enumerate(pieces()):
        if not length:
            continue
        if length > codes.shape[1]:
            break
        moved = np.zeros_like(key)
        moved[:, 1:] = key[:, :-1] * np.uint64(BASE)
        key = moved + codes
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1) if len(keys) else None
        found = np.where(keys[place] == key, numbers[place], -1) if len(keys) else np.full(key.shape, -1)
        found[:, : length - 1] = -1
        out.append(found)
    return out


def forward(steps: list[np.ndarray], p: np.ndarray) -> np.ndarray:
    """alpha (words, places + 1, columns of p): summed probability of all segmentations of each prefix.  p: a row per piece and a last row of zeros."""
    n, places = steps[0].shape
    alpha = np.zeros((n, places + 1, p.shape[1]))
    alpha[:, 0] = 1
    for j in range(places):
        for length, found in enumerate(steps[: j + 1], 1):
            alpha[:, j + 1] += alpha[:, j + 1 - length] * p[found[:, j]]
    return alpha


def log_forward(words: list[bytes], p: np.ndarray) -> np.ndarray:
    """Log of the summed probability of all segmentations of words of one length, for each column of p.

    Only the last places, as many as the longest piece has bytes, are kept; they are divided by the newest one every RESCALE places.  Every byte is a piece, so no place is impossible.
    """
    codes = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)
    n, places = codes.shape
    longest = len(pieces()) - 1
    tail, logs = np.zeros((n, longest, p.shape[1])), np.zeros((n, p.shape[1]))
    tail[:, -1] = 1
    for start in range(0, places, SPAN):
        end, back = min(start + SPAN, places), max(0, start - longest + 1)
        steps = [found[:, start - back :] for found in _lattice(codes[:, back:end])]
        alpha = np.concatenate([tail, np.zeros((n, end - start, p.shape[1]))], axis=1)
        for j in range(end - start):
            now = alpha[:, longest + j]
            for length, found in enumerate(steps, 1):
                at = found[:, j]
                if (at >= 0).any():
                    now += alpha[:, longest + j - length] * p[at]
            if (start + j) % RESCALE == RESCALE - 1:
                logs += np.log(now)
                alpha[:, j + 1 : longest + j + 1] /= now[:, None].copy()
        tail = alpha[:, -longest:]
    return logs + np.log(tail[:, -1])


def by_length(words: list[bytes], most: int = 8192) -> Iterator[np.ndarray]:
    """Indices of words of equal length, in bounded lots."""
    lengths = np.array([len(w) for w in words])
    order = np.argsort(lengths, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        for at in range(0, len(part), most):
            if len(part):
                yield part[at : at + most]


def word_scores(words: list[bytes], p: np.ndarray) -> np.ndarray:
    """Log probability of each word for each column of p."""
    marked = [b" " + w for w in words]
    out = np.zeros((len(words), p.shape[1]))
    most = max(1, 2_000_000 // ((SPAN + len(pieces())) * p.shape[1]))
    for lot in by_length(marked, most):
        out[lot] = log_forward([marked[i] for i in lot], p)
    return out


def expected_counts(words: list[bytes], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece over all segmentations of the words, each read whole.  p: one column."""
    marked, out = [b" " + w for w in words], np.zeros(len(p))
    for lot in by_length(marked):
        most = max(1, 2_000_000 // len(marked[lot[0]]))
        for k in range(0, len(lot), most):
            some = lot[k : k + most]
            codes = np.frombuffer(b"".join(marked[i] for i in some), np.uint8).reshape(len(some), -1)
            out += _uses(codes, np.asarray(counts, float)[some], p[:, 0])
    return out


def _uses(codes: np.ndarray, weight: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Forward and backward sums over words of one length, both divided by their newest place every RESCALE places, and what each piece is used between them."""
    n, places = codes.shape
    longest, spans = len(pieces()) - 1, range(0, places, SPAN)
    alpha, scale = np.ones((n, places + 1)), np.zeros((n, places + 1))  # alpha[:, j] is to be multiplied by exp(scale[:, j])
    tail, logs = np.zeros((n, longest)), np.zeros(n)
    tail[:, -1] = 1
    for start in spans:
        end, back = min(start + SPAN, places), max(0, start - longest + 1)
        steps = [found[:, start - back :] for found in _lattice(codes[:, back:end])]
        work = np.concatenate([tail, np.zeros((n, end - start))], axis=1)
        for j in range(end - start):
            now = work[:, longest + j]
            for length, found in enumerate(steps, 1):
                at = found[:, j]
                if (at >= 0).any():
                    now += work[:, longest + j - length] * p[at]
            if (start + j) % RESCALE == RESCALE - 1:
                logs = logs + np.log(now)
                work[:, j + 1 : longest + j + 1] /= now[:, None].copy()
            alpha[:, start + j + 1], scale[:, start + j + 1] = work[:, longest + j], logs
        tail = work[:, -longest:]
    whole = scale[:, -1] + np.log(alpha[:, -1])

    head, logs, out = np.zeros((n, longest)), np.zeros(n), np.zeros(len(p))
    head[:, 0] = 1
    for start in reversed(spans):
        end = min(start + SPAN, places)
        steps = _lattice(codes[:, start : min(end + longest - 1, places)])
        work = np.concatenate([np.zeros((n, end - start)), head], axis=1)
        for j in reversed(range(end - start)):
            now, pieces_here, values = work[:, j], [], []
            for length, found in enumerate(steps, 1):
                if start + j + length > places:
                    break
                at = found[:, j + length - 1]
                if (at >= 0).any():
                    value = work[:, j + length] * p[at]
                    now += value
                    pieces_here.append(at)
                    values.append(value)
            share = weight * alpha[:, start + j] * np.exp(scale[:, start + j] + logs - whole)
            out += np.bincount(np.concatenate(pieces_here) % len(p), weights=(np.array(values) * share).ravel(), minlength=len(p))
            if (places - start - j) % RESCALE == 0:
                logs = logs + np.log(now)
                work[:, j : j + longest] /= now[:, None].copy()
        head = work[:, :longest]
    return out


def word_counts(labelled: DataFrame) -> DataFrame:
    """lang, word, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple[str, bytes], int] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w in words_of(text):
                    seen[lang, w] = seen.get((lang, w), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.binary()), pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])

    return labelled.select("lang", "text").mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, learn: Column, sample: int = SAMPLE, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages, and probabilities (pieces + a row of zeros, languages), from the rows of docs where `learn` holds."""
    spark = docs.sparkSession
    usable = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang")
    drawn = bounded_sample(usable, "lang", "doc_id", sample)
    drawn = small_side(materialise(drawn.select("doc_id").distinct()))  # at most `sample` ids a language
    words = materialise(word_counts(docs.filter(learn & F.col("lang").isNotNull()).join(drawn, "doc_id", "left_semi")))
    langs = sorted(r.lang for r in words.select("lang").distinct().collect())
    p = np.full((n_pieces() + 1, max(1, len(langs))), 1 / n_pieces())
    p[-1] = 0
    for _ in range(rounds if langs else 0):
        shared = spark.sparkContext.broadcast(p)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for frame in batches:
                for lang, own in frame.groupby("lang", sort=False):
                    k = langs.index(lang)
                    got = expected_counts([bytes(w) for w in own["word"]], own["n"].to_numpy(np.float64), shared.value[:, [k]])
                    at = np.flatnonzero(got[:-1])
                    yield pd.DataFrame({"k": k, "piece": at, "uses": got[at]})

        uses = words.mapInPandas(run, "k int, piece int, uses double").groupBy("k", "piece").agg(F.sum("uses").alias("uses")).toArrow().to_pandas()
        p = np.full(p.shape, PRIOR)
        p[uses["piece"], uses["k"]] += uses["uses"]
        p[-1] = 0
        p /= p.sum(axis=0)
    return langs, p


class WordTable:
    """Scores of the words met so far, at most KNOWN_SCORES of them over all columns."""

    def __init__(self, p: np.ndarray):
        self.most = max(1, KNOWN_SCORES // p.shape[1])
        self.p, self.at, self.scores, self.used = p, {}, np.zeros((self.most, p.shape[1])), 0

    def lookup(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Summed log probabilities of each text's words."""
        new = {w for words in texts for w in words if w not in self.at}
        if self.used + len(new) > self.most:
            self.at, self.used = {}, 0
            new = {w for words in texts for w in words}
        new = list(new)
        scores = self.scores
        if len(new) > self.most:  # more than the table holds: for this lot only
            at, scores = {w: i for i, w in enumerate(new)}, word_scores(new, self.p)
        else:
            scores[self.used : self.used + len(new)] = word_scores(new, self.p)
            self.at.update((w, self.used + i) for i, w in enumerate(new))
            self.used += len(new)
            at = self.at
        return [scores[[at[w] for w in words]].sum(axis=0) if words else np.zeros(self.p.shape[1]) for words in texts]


def identify(docs: DataFrame, learn: Column, sample: int = SAMPLE, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score.  Labels are learned where `learn` holds."""
    langs, p = train(docs, learn, sample, rounds)
    shared = docs.sparkSession.sparkContext.broadcast(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(shared.value)
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for first in range(0, len(texts), 500):
                lot = texts[first : first + 500]
                sums = np.array(table.lookup([words_of(t) for t in lot]))
                odds = np.exp(sums - sums.max(axis=1, keepdims=True))
                share = odds / odds.sum(axis=1, keepdims=True)
                best = share.argmax(axis=1)
                known = [bool(langs) and has_letter(t) for t in lot]
                names = [langs[k] if ok else "und" for k, ok in zip(best, known)]
                score = [float(s) if ok else 0.0 for s, ok in zip(share.max(axis=1), known)]
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(lot)), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
