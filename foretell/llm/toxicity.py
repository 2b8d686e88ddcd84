"""Toxicity by a bidirectional gated recurrent network with attention pooling (operator 5), trained in numpy.

Words of more than LONG bytes are read in overlapping parts of that length.  A word's input is the mean of learned vectors of its hashed character trigrams, next to a learned vector of the hashed word itself.  Two gated recurrent units read a window of WINDOW words, one from each end; attention pools their states, and a logistic unit scores the window.  Windows start every STRIDE words, so neighbours overlap by half, and the whole text is covered.  A document's score comes from its largest window logit by a logistic curve fitted on labelled documents that were not trained on.

Training uses a bounded sample on the driver: the `sample` rows of each label whose hashed id is smallest, whole texts.  It is drawn in two steps, shards of a label first, so the second step sees at most 16 * `sample` rows of a label however many there are.  A first pass labels windows like their documents; in two more a toxic document keeps as toxic its highest window and those above nearly all clean windows (`RARE`), and its other windows are left out.

Scoring runs where documents are read, without a shuffle.  A word's input to both units is computed once per task and kept in a table of bounded size, which grows by doubling; windows are cut for a batch at once and scored in lots that fit a cache.

Defined cases: null and empty texts, and texts without a letter, score 0; whole texts are read; repeated rows give repeated results, and are one row of training; rows with a null label are not learned from; other columns are ignored; an empty table gives an empty result; without both labels in training every score is 0.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretell.llm.common import bounded_sample, small_side
from foretell.llm.words import words_of

WINDOW, STRIDE = 32, 16
#: Bytes of the parts that long words are read in, and bytes that neighbours share.
LONG, LAP = 64, 16
HIDDEN, PART, ATTENTION = 8, 8, 8
WORDS, TRIGRAMS = 1 << 14, 1 << 14
SAMPLE, STEPS, LOT = 1000, 200, 256
#: A toxic document's window counts as toxic if its logit exceeds that of so many clean windows.
RARE = 0.998
#: Words in so many sampled documents get a vector of their own; rarer ones would only be learned by heart.
COMMON = 10
KNOWN_WORDS = 200_000


def parts_of(text: str | None) -> list[bytes]:
    """The words of a text; one of more than LONG bytes (such as a text without blanks) as overlapping parts, so that all of it is read."""
    words = words_of(text)
    if max(map(len, words), default=0) <= LONG:
        return words
    return [w[k : k + LONG] for w in words for k in range(0, max(len(w) - LAP, 1), LONG - LAP)]


def trigrams(word: bytes) -> list[int]:
    """Hashed character trigrams of a word with its ends marked."""
    w = b"<" + word + b">"
    return [(((w[k] << 16) | (w[k + 1] << 8) | w[k + 2]) * 0x9E3779B1 >> 15) % TRIGRAMS for k in range(len(w) - 2)]


def trigrams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of all words, one word after another, and how many each has."""
    octets = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(np.int64)
    n = np.fromiter(map(len, words), np.int64, len(words))
    inside = np.ones(len(octets), bool)  # every place begins a trigram but the last two of a word
    ends = np.cumsum(n + 2)
    inside[ends - 1] = inside[ends - 2] = False
    at = np.flatnonzero(inside)
    return (((octets[at] << 16) | (octets[at + 1] << 8) | octets[at + 2]) * 0x9E3779B1 >> 15) % TRIGRAMS, n


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Words:
    """Trigrams (flat, with owners) and hashed ids of a list of different words."""

    def __init__(self, words: list[bytes]):
        self.flat, size = trigrams_of(words) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.n = np.maximum(size, 1)
        self.owner = np.repeat(np.arange(len(words)), size)
        self.ids = np.array([zlib.crc32(w) % WORDS for w in words], np.int64)
        self.ends = np.cumsum(size)

    def take(self, at: np.ndarray) -> Words:
        """The same for the words at these places."""
        out = object.__new__(Words)
        size = np.diff(self.ends, prepend=0)[at]
        out.n, out.ids, out.owner = self.n[at], self.ids[at], np.repeat(np.arange(len(at)), size)
        out.ends = np.cumsum(size)
        out.flat = self.flat[np.arange(size.sum()) + np.repeat(self.ends[at] - out.ends, size)]
        return out

    def inputs(self, chars: np.ndarray, words: np.ndarray) -> np.ndarray:
        mean = np.stack([np.bincount(self.owner, weights=chars[self.flat, d], minlength=len(self.ids)) for d in range(PART)], axis=1) / self.n[:, None]
        return np.concatenate([mean.astype(words.dtype), words[self.ids]], axis=1)

    def back(self, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the two tables from the inputs' gradients."""
        each = (grad[:, :PART] / self.n[:, None])[self.owner]
        chars = np.stack([np.bincount(self.flat, weights=each[:, d], minlength=TRIGRAMS) for d in range(PART)], axis=1)
        words = np.stack([np.bincount(self.ids, weights=grad[:, PART + d], minlength=WORDS) for d in range(PART)], axis=1)
        return chars, words


def starts(n: int) -> range:
    """First words of the windows of n words; none without words."""
    return range(0, max(n - STRIDE, 1), STRIDE) if n else range(0)


def windows(docs: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers (windows, WINDOW; -1 where a window ends early) and the document of each window."""
    n = np.fromiter(map(len, docs), np.int64, len(docs))
    return cut(np.fromiter(chain.from_iterable(docs), np.int64, n.sum()), n)


def cut(flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for documents of n words each, one after another in flat."""
    each = np.where(n > 0, -(-np.maximum(n - STRIDE, 1) // STRIDE), 0)
    owner = np.repeat(np.arange(len(n)), each)
    start = (np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)) * STRIDE
    place = start[:, None] + np.arange(WINDOW)
    inside = place < n[owner][:, None]
    out = np.full(place.shape, -1, np.int64)
    out[inside] = flat[(place + (np.cumsum(n) - n)[owner][:, None])[inside]]
    return out, owner


class Network:
    """Parameters, a forward pass and its gradient."""

    def __init__(self, seed: int = 7, kind: type = np.float32):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.3 / np.sqrt(shape[0]), shape)
        h = HIDDEN
        self.p: dict[str, np.ndarray] = {"chars": rng.normal(0, 0.1, (TRIGRAMS, PART)), "words": rng.normal(0, 0.02, (WORDS, PART)), "attend": draw(2 * h, ATTENTION), "query": draw(ATTENTION), "out": draw(2 * h), "bias": np.zeros(1)}
        for side in "fb":
            self.p |= {f"in_{side}": draw(2 * PART, 3 * h), f"rec_{side}": draw(h, 3 * h), f"add_{side}": np.zeros(3 * h)}
        self.p = {k: v.astype(kind) for k, v in self.p.items()}
        self.common = np.ones((WORDS, 1), kind)

    def restrict(self, words: list[bytes]) -> None:
        """Only these words have a learned vector of their own; all others are read by their trigrams alone."""
        self.common[:] = 0
        self.common[[zlib.crc32(w) % WORDS for w in words]] = 1
        self.p["words"] *= self.common

    def project(self, words: Words) -> dict[str, np.ndarray]:
        """Each word's contribution to the gates of both units; the last row is for places without a word."""
        x = words.inputs(self.p["chars"], self.p["words"])
        return {side: np.vstack([x @ self.p[f"in_{side}"] + self.p[f"add_{side}"], np.zeros((1, 3 * HIDDEN), self.p["bias"].dtype)]) for side in "fb"}

    def unit(self, side: str, gates: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (windows, WINDOW, HIDDEN) of one unit.  gates: (windows, WINDOW, 3 * HIDDEN)."""
        h, rec = HIDDEN, self.p[f"rec_{side}"]
        state, out = np.zeros((len(gates), h), gates.dtype), np.empty((*mask.shape, h), gates.dtype)
        for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
            g = gates[:, t]
            pull = state @ rec
            zr = sigmoid(g[:, : 2 * h] + pull[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(g[:, 2 * h :] + r * pull[:, 2 * h :])
            m = mask[:, t, None]
            if keep is not None:
                keep.append((t, state, z, r, new, pull[:, 2 * h :]))
            state = state + m * z * (new - state)
            out[:, t] = state
        return out

    def logits(self, gates: dict[str, np.ndarray], mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        mask = mask.astype(gates["f"].dtype)
        kept = {side: [] for side in "fb"} if keep is not None else {side: None for side in "fb"}
        states = np.concatenate([self.unit(side, gates[side], mask, kept[side]) for side in "fb"], axis=2)
        hidden = np.tanh(states @ self.p["attend"])
        score = hidden @ self.p["query"]
        score = np.where(mask > 0, score, -1e9)
        share = np.exp(score - score.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        pooled = (share[:, :, None] * states).sum(axis=1)
        if keep is not None:
            keep |= {"units": kept, "states": states, "hidden": hidden, "share": share, "pooled": pooled, "mask": mask}
        return pooled @ self.p["out"] + self.p["bias"][0]

    def gradient(self, words: Words, numbers: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean logistic loss of windows and its gradient."""
        mask = numbers >= 0
        gates = {side: g[numbers] for side, g in self.project(words).items()}
        keep: dict = {}
        logit = self.logits(gates, mask, keep)
        prob = sigmoid(logit.astype(np.float64))
        loss = -np.mean(labels * np.log(prob + 1e-12) + (1 - labels) * np.log(1 - prob + 1e-12))
        d = ((prob - labels) / len(labels)).astype(logit.dtype)
        states, share, hidden, m = keep["states"], keep["share"], keep["hidden"], keep["mask"]
        g = {"out": keep["pooled"].T @ d, "bias": np.array([d.sum()])}
        d_pooled = d[:, None] * self.p["out"]
        d_states = share[:, :, None] * d_pooled[:, None]
        d_share = (states * d_pooled[:, None]).sum(axis=2)
        d_score = share * (d_share - (share * d_share).sum(axis=1, keepdims=True)) * m
        d_hidden = d_score[:, :, None] * self.p["query"] * (1 - hidden**2)
        g["query"] = np.tensordot(d_score, hidden, 2)
        g["attend"] = np.tensordot(states, d_hidden, ((0, 1), (0, 1)))
        d_states = d_states + d_hidden @ self.p["attend"].T
        x = words.inputs(self.p["chars"], self.p["words"])
        d_x = np.zeros_like(x)
        h = HIDDEN
        for k, side in enumerate("fb"):
            rec, part = self.p[f"rec_{side}"], d_states[:, :, k * h : (k + 1) * h]
            d_rec, d_gates, carry = np.zeros_like(rec), np.zeros_like(gates[side]), np.zeros((len(labels), h), rec.dtype)
            for t, state, z, r, new, pull in reversed(keep["units"][side]):
                total = part[:, t] + carry
                own = total * m[:, t, None]
                d_new = own * z * (1 - new**2)
                d_z = own * (new - state) * z * (1 - z)
                d_r = d_new * pull * r * (1 - r)
                d_pull = np.concatenate([d_z, d_r, d_new * r], axis=1)
                d_gates[:, t] = np.concatenate([d_z, d_r, d_new], axis=1)
                d_rec += state.T @ d_pull
                carry = total - own * z + d_pull @ rec.T
            flat, at = d_gates[m > 0], numbers[m > 0]
            by_word = np.stack([np.bincount(at, weights=flat[:, c], minlength=len(x)) for c in range(3 * h)], axis=1).astype(x.dtype)
            g |= {f"rec_{side}": d_rec, f"in_{side}": x.T @ by_word, f"add_{side}": by_word.sum(axis=0)}
            d_x += by_word @ self.p[f"in_{side}"].T
        g["chars"], g["words"] = words.back(d_x)
        return float(loss), g


def fit(network: Network, numbers: np.ndarray, labels: np.ndarray, vocabulary: Words, steps: int, seed: int = 1) -> None:
    """`steps` steps of Adam over shuffled lots of windows."""
    rng, rate, lots = np.random.default_rng(seed), 0.01, []
    first = {k: np.zeros_like(v) for k, v in network.p.items()}
    second = {k: np.zeros_like(v) for k, v in network.p.items()}
    for step in range(1, steps + 1):
        lots = lots or np.array_split(rng.permutation(len(numbers)), max(1, len(numbers) // LOT))
        lot = lots.pop()
        used, at = np.unique(numbers[lot], return_inverse=True)
        at = at.reshape(numbers[lot].shape) - (used[0] < 0)
        own = vocabulary.take(used[used >= 0])
        _, g = network.gradient(own, at, labels[lot])
        g["words"] *= network.common
        for k, v in g.items():
            first[k] += 0.1 * (v - first[k])
            second[k] += 0.01 * (v * v - second[k])
            network.p[k] -= np.float32(rate) * (first[k] / np.float32(1 - 0.9**step)) / (np.sqrt(second[k] / np.float32(1 - 0.99**step)) + np.float32(1e-8))


class Scorer:
    """Window logits of documents, with a bounded table of words met."""

    def __init__(self, network: Network):
        self.network = network
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.gates = {side: np.zeros((0, 3 * HIDDEN), np.float32) for side in "fb"}

    def learn(self, words: list[bytes]) -> None:
        """Add words to the table, whose room doubles when it is full."""
        fresh, first = self.network.project(Words(words)), len(self.at)
        self.at |= {w: first + i for i, w in enumerate(words)}
        for side, g in self.gates.items():
            if len(self.at) > len(g):
                g = np.zeros((max(len(self.at), min(2 * len(g), KNOWN_WORDS)), 3 * HIDDEN), np.float32)
                g[:first] = self.gates[side][:first]
                self.gates[side] = g
            g[first : len(self.at)] = fresh[side][:-1]

    def largest(self, docs: list[list[bytes]], lot: int = 512) -> np.ndarray:
        """The largest window logit of each document; -inf without words."""
        words = set(chain.from_iterable(docs))
        new = [w for w in words if w not in self.at]
        if len(self.at) + len(new) > KNOWN_WORDS:
            self.clear()
            new = list(words)
        if new:
            self.learn(new)
        n = np.fromiter(map(len, docs), np.int64, len(docs))
        numbers, owner = cut(np.fromiter(map(self.at.__getitem__, chain.from_iterable(docs)), np.int64, n.sum()), n)
        out = np.full(len(docs), -np.inf)
        for k in range(0, len(numbers), lot):  # lots whose gates fit a core's cache
            some = numbers[k : k + lot]
            np.maximum.at(out, owner[k : k + lot], self.network.logits({side: g[some] for side, g in self.gates.items()}, some >= 0))
        return out


def platt(logit: np.ndarray, labels: np.ndarray, rounds: int = 500) -> tuple[float, float]:
    """Slope (positive) and intercept of the logistic curve from logits to labels, with smoothed targets; gradient steps on centred logits."""
    middle, width = np.median(logit), max(float(np.std(logit)), 1e-6)
    x, up = (logit - middle) / width, labels.sum()
    target = np.where(labels > 0, (up + 1) / (up + 2), 1 / (len(labels) - up + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        d = sigmoid(a * x + b) - target
        a, b = max(1e-3, a - np.mean(d * x)), b - np.mean(d)
    return a / width, b - a * middle / width


def train(texts: list[str | None], labels: np.ndarray, steps: int = STEPS) -> tuple[Network, float, float] | None:
    """Network and curve from labelled texts with words; every fifth one only serves the curve, which all serve where those lack a label.  None unless both labels are among the others."""
    docs = [parts_of(t) for t in texts]
    labels, docs = labels[[bool(words) for words in docs]], [words for words in docs if words]
    fitted = np.arange(len(docs)) % 5 != 0
    if len(set(labels[fitted])) < 2:
        return None
    at = {w: i for i, w in enumerate(sorted({w for words in docs for w in words}))}
    vocabulary = Words(list(at))
    used = [[at[w] for w in docs[i]] for i in np.flatnonzero(fitted)]
    numbers, owner = windows(used)
    toxic = labels[fitted][owner].astype(float)
    spread = Counter(w for i in np.flatnonzero(fitted) for w in set(docs[i]))
    common = [w for w, n in spread.items() if n >= COMMON]
    network, clean = Network(), toxic == 0
    network.restrict(common)
    keep = np.ones(len(numbers), bool)
    for turn in range(3):
        if turn:
            gates = network.project(vocabulary)
            logit = np.concatenate([network.logits({s: g[part] for s, g in gates.items()}, part >= 0) for part in np.array_split(numbers, len(numbers) // 2048 + 1)])
            best = np.full(len(used), -np.inf)
            np.maximum.at(best, owner, logit)
            keep = clean | (logit >= best[owner]) | (logit > np.quantile(logit[clean], RARE))
            if turn == 1:
                network = Network()
                network.restrict(common)
        fit(network, numbers[keep], toxic[keep], vocabulary, steps, seed=turn)
    rest = np.flatnonzero(~fitted)
    rest = rest if len(set(labels[rest])) == 2 else np.arange(len(docs))
    largest = Scorer(network).largest([docs[i] for i in rest])
    return network, *platt(largest, labels[rest].astype(float))


def score(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE, steps: int = STEPS) -> DataFrame:
    """One row per row of docs: doc_id, score.  labels: doc_id, toxic; learned where `learn` (of doc_id) holds.  Of labels that clash the higher counts, of texts that share an id the one whose hash is least."""
    usable = labels.filter(learn & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = bounded_sample(usable, "toxic", "doc_id", sample)
    drawn = docs.join(small_side(drawn), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    model = train(drawn["text"].to_pylist(), np.array(drawn["toxic"].to_pylist(), np.int64), steps)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, slope, shift = shared.value or (Network(), 0.0, -np.inf)
        scorer = Scorer(network)
        for b in batches:
            for first in range(0, len(b), 200):
                lot = b.slice(first, 200)
                words = [parts_of(t) for t in lot.column(1).to_pylist()]
                if shared.value is None:
                    out = np.zeros(len(words))
                else:
                    logit = scorer.largest(words)
                    out = np.where(np.isfinite(logit), sigmoid(slope * np.where(np.isfinite(logit), logit, 0) + shift), 0.0)
                yield pa.RecordBatch.from_arrays([lot.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
