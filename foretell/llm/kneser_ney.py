"""Quality by an interpolated modified Kneser-Ney n-gram model (operator 4).

The model is over characters, one per language, trained on trusted text: documents labelled quality 1, of which those whose hashed id is 0 mod `fold` are held out.  Every code point of a language's trusted text is a symbol of its own; all others share one, which changes no probability, as the model knows none of them.  An n-gram is one long: 12 bits a symbol and order 5 where a language has fewer than 4,095 symbols, else 15 bits and order 4, else 21 bits and order 3 (WIDTHS); a width is a model, and nearly always there is only one.  The symbols (at most Unicode's code points a language, as a rule some hundreds) are a table that the driver sends to the tasks.  Every text is read whole, preceded by order - 1 start symbols.

Model: at the highest order counts are occurrences, below it the number of different left neighbours.  Discounts D1, D2, D3+ of each order and language come from its counts of counts.  p(w | h) = max(c - D(c), 0) / total(h) + gamma(h) * p(w | shorter h), down to the uniform distribution over the language's symbols.  All tables are sharded by the hash of the n-gram or its context and joined.

Scoring: tasks ask for each different n-gram of their text once, and the questions are resolved by the chain of joins over distinct n-grams.  While the answers number at most MOST_ANSWERS (counted first; 16 bytes each) they are sent to the tasks, which score their documents where these are read.  Beyond that, documents are dealt to blocks of about BLOCK_CHARS characters and each block meets its own answers in a co-group.  Both ways give the same numbers.

Decision: a document is rejected if its perplexity lies above the `upper` quantile (or below the `lower` one, if given) of its language's held-out trusted documents.  Limits are percentiles of log perplexity, widened by `slack` and, since the mean over few characters strays further, by `spread` over the root of the document's characters.  A language without held-out trusted documents rejects nothing.

Defined cases: a null language is a language of its own; null, empty and blank texts have no characters, hence perplexity null and are kept; repeated rows are scored each and counted once for each row in training; a repeated label row counts once; other columns are ignored by `perplexity`; empty tables give empty results, and without trusted text every perplexity is null and everything is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretell.llm.common import few, fresh, materialise, scratch, small_side, tidy

ORDER = 5
BITS = 12
#: Bits a symbol and order of the model, for languages whose symbols fit.
WIDTHS = ((BITS, ORDER), (15, 4), (21, 3))
BLOCK_CHARS = 8_000_000
MOST_ANSWERS = 2_000_000
LOT_CHARS = 2_000_000
#: N-grams for which a task is worth its while.
LOT = 100_000
#: Symbols of what is not in a language's trusted text, and of what stands before a text.
UNSEEN, START = 0, 1
#: The language key of rows whose language is null.
NO_LANGUAGE = "\x00none"


class Symbols:
    """The symbols of languages (their code points, ascending), for n-grams of `order` symbols of `bits` bits."""

    def __init__(self, alphabets: dict[str, np.ndarray], order: int, bits: int):
        if any(len(a) + 2 > 1 << bits for a in alphabets.values()) or order * bits > 63:
            raise ValueError("symbols do not fit")
        self.alphabets, self.order, self.bits, self._tables = alphabets, order, bits, {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tables": {}}

    def _table(self, lang: str) -> np.ndarray:
        """The symbol of each code point up to one beyond the language's last."""
        if lang not in self._tables:
            own = self.alphabets.get(lang, np.empty(0, np.int64))
            table = np.full(int(own[-1]) + 2 if len(own) else 1, UNSEEN, np.int64)
            table[own] = np.arange(2, len(own) + 2)
            self._tables[lang] = table
        return self._tables[lang]

    def grams(self, lang: str, text: str) -> np.ndarray:
        """The n-grams of a text that end in each of its characters, oldest character in the highest bits."""
        points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
        codes = self._table(lang).take(points.astype(np.int64), mode="clip")
        padded = np.concatenate([np.full(self.order - 1, START, np.int64), codes])
        out = np.zeros(len(codes), np.int64)
        for k in range(self.order):
            out = (out << self.bits) | padded[k : k + len(codes)]
        return out


def alphabets(docs: DataFrame) -> dict[str, np.ndarray]:
    """The code points of each language's texts, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, texts in b.to_pandas().groupby("lang", sort=False)["text"]:
                points = np.unique(np.concatenate([np.empty(0, np.uint32), *[np.unique(np.frombuffer((t or "").encode("utf-32-le", "replace"), "<u4")) for t in texts]])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(points), pa.string()), pa.array(points)], ["lang", "point"])

    found = _language(docs).select("lang", "text").mapInArrow(tidy(run), "lang string, point long").distinct().toArrow().to_pandas()
    return {lang: np.sort(own.to_numpy()) for lang, own in found.groupby("lang", sort=False)["point"]}


def _text_grams(texts: list[str | None], symbols: Symbols, lang: str) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the texts, and how many each text has."""
    each = [symbols.grams(lang, t or "") for t in texts]
    return np.concatenate([np.empty(0, np.int64), *each]), np.array([len(g) for g in each], np.int64)


def _lots(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in lots of at most LOT_CHARS characters (a longer text is a lot of its own)."""
    lot, size = [], 0
    for t in texts:
        if lot and size + len(t or "") > LOT_CHARS:
            yield lot
            lot, size = [], 0
        lot.append(t)
        size += len(t or "")
    if lot:
        yield lot


def _tally(texts: list[str | None], symbols: Symbols, lang: str) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of the texts and how often each occurs."""
    parts = [np.unique(_text_grams(lot, symbols, lang)[0], return_counts=True) for lot in _lots(texts)]
    codes, unique = pd.factorize(np.concatenate([np.empty(0, np.int64), *[g for g, _ in parts]]))
    return np.asarray(unique, np.int64), np.bincount(codes, weights=np.concatenate([np.empty(0), *[n for _, n in parts]]), minlength=len(unique)).astype(np.int64)


def _language(docs: DataFrame) -> DataFrame:
    return docs.withColumn("lang", F.coalesce(F.col("lang"), F.lit(NO_LANGUAGE)))


def counts(docs: DataFrame, symbols: Symbols) -> DataFrame:
    """lang, gram, c: occurrences of n-grams of the highest order; tasks count their own text before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            frame = b.to_pandas()
            for lang, texts in frame.groupby("lang", sort=False)["text"]:
                unique, n = _tally(texts.tolist(), symbols, lang)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(unique), pa.string()), pa.array(unique), pa.array(n)], ["lang", "gram", "c"])

    return _language(docs).select("lang", "text").mapInArrow(tidy(run), "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


class Model:
    """Tables of a Kneser-Ney model: per order the adjusted counts (lang, gram, c) and the contexts (lang, ctx, total, gamma)."""

    def __init__(self, docs: DataFrame, order: int = ORDER, bits: int = BITS, known: dict[str, np.ndarray] | None = None):
        """known: the alphabets of docs, if they are at hand."""
        self.order, self.bits = order, bits
        self.writing = Symbols(alphabets(docs) if known is None else known, order, bits)
        table = materialise(counts(docs, self.writing))
        self.tables, self.contexts, self.rows = {order: table}, {}, {order: table.count()}
        for n in range(order - 1, 0, -1):
            shorter = F.col("gram").bitwiseAND(F.lit((1 << self.bits * n) - 1))
            table = materialise(few(table.groupBy("lang", shorter.alias("gram")).agg(F.count("*").alias("c")), self.rows[n + 1], LOT))
            self.tables[n], self.rows[n] = table, table.count()
        self.discounts = self._discounts()
        self.symbols = self.tables[1].groupBy("lang").agg(F.count("*").alias("symbols"))
        for n, table in self.tables.items():
            own = self.discounted(n)
            ctx = F.shiftright("gram", self.bits).alias("ctx")
            contexts = own.groupBy("lang", ctx).agg(F.sum("c").alias("total"), F.sum("d").alias("off")).select("lang", "ctx", "total", (F.col("off") / F.col("total")).alias("gamma"))
            self.contexts[n] = materialise(few(contexts, self.rows[n], LOT))

    def _discounts(self) -> DataFrame:
        """lang, n, d1, d2, d3: at most order rows per language."""
        out = None
        for n, table in self.tables.items():
            have = table.groupBy("lang").agg(*[F.count(F.when(F.col("c") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)])
            y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
            d = [F.greatest(F.lit(0.0), F.least(F.lit(float(k)), F.coalesce(k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}")), F.lit(0.5 * k)))) for k in (1, 2, 3)]
            rows = have.select("lang", F.lit(n).alias("n"), *[x.alias(f"d{k}") for k, x in zip((1, 2, 3), d)])
            out = rows if out is None else out.unionByName(rows)
        return materialise(few(out, self.order * len(self.writing.alphabets)))

    def discounted(self, n: int) -> DataFrame:
        """lang, gram, c, d: the counts of an order and what is taken off each."""
        d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        return self.tables[n].join(self.discounts.filter(F.col("n") == n), "lang").select("lang", "gram", "c", F.least(d, F.col("c")).alias("d"))

    def probabilities(self, asked: DataFrame) -> DataFrame:
        """lang, gram, p for the distinct (lang, gram) of the highest order in asked, a written table; languages the model does not have drop out."""
        level, most = asked.select("lang", "gram"), asked.count()
        lot = lambda df: few(df, most, LOT)  # noqa: E731  no level has more n-grams than the one above it
        levels = {self.order: level}
        for n in range(self.order - 1, 0, -1):
            level = level.select("lang", F.col("gram").bitwiseAND(F.lit((1 << self.bits * n) - 1)).alias("gram")).distinct()
            levels[n] = level
        below = None
        for n in range(1, self.order + 1):
            seen = self.discounted(n).select("lang", "gram", (F.col("c") - F.col("d")).alias("kept"))
            q = lot(levels[n].join(seen, ["lang", "gram"], "left")).withColumn("ctx", F.shiftright("gram", self.bits))
            q = lot(q.join(self.contexts[n], ["lang", "ctx"], "left"))
            if n == 1:
                q = q.join(self.symbols, "lang").withColumn("lower", 1 / (F.col("symbols") + 1))
            else:
                q = q.withColumn("low", F.col("gram").bitwiseAND(F.lit((1 << self.bits * (n - 1)) - 1))).join(below.select("lang", F.col("gram").alias("low"), F.col("p").alias("lower")), ["lang", "low"])
            p = F.coalesce(F.col("kept") / F.col("total"), F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * F.col("lower")
            below = materialise(lot(q.select("lang", "gram", p.alias("p"))))
        return below


def _scores(texts: list[str | None], symbols: Symbols, lang: str, have: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters and mean loss of each text (nan without characters), from the sorted n-grams `have` and their log probabilities."""
    found, n = _text_grams(texts, symbols, lang)
    if not len(found) or not len(have):
        return n, np.full(len(texts), np.nan)
    codes, unique = pd.factorize(found)
    sums = np.concatenate([[0.0], np.cumsum(logp[np.searchsorted(have, unique)][codes])])
    ends = np.cumsum(n)
    return n, np.where(n > 0, -(sums[ends] - sums[ends - n]) / np.maximum(n, 1), np.nan)


def _score_frame(frame: pd.DataFrame, symbols: Symbols, table: dict[str, tuple[np.ndarray, np.ndarray]]) -> Iterator[pd.DataFrame]:
    none = (np.empty(0, np.int64), np.empty(0))
    for lang, own in frame.groupby("lang", sort=False):
        parts = [_scores(lot, symbols, lang, *table.get(lang, none)) for lot in _lots(own["text"].tolist())]
        n, loss = (np.concatenate(x) for x in zip(*parts))
        yield pd.DataFrame({"doc_id": own["doc_id"].to_numpy(), "text_hash": own["text_hash"].to_numpy(), "lang": lang, "n_chars": n, "loss": loss})


def _ask(docs: DataFrame, symbols: Symbols, keys: list[str]) -> DataFrame:
    """The different n-grams by `keys` (lang, and block if dealt); tasks keep each n-gram of a batch once."""
    schema = ", ".join(f"{k} {'int' if k == 'block' else 'string'}" for k in keys) + ", gram long"
    kinds = [pa.int32() if k == "block" else pa.string() for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, texts in b.to_pandas().groupby(keys, sort=False)["text"]:
                unique = np.asarray(pd.unique(np.concatenate([pd.unique(_text_grams(lot, symbols, key[-1])[0]) for lot in _lots(texts.tolist())])), np.int64)
                yield pa.RecordBatch.from_arrays([*[pa.array([k] * len(unique), kind) for k, kind in zip(key, kinds)], pa.array(unique)], [*keys, "gram"])

    return docs.mapInArrow(tidy(run), schema).distinct()


def _sorted(gram: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(gram)
    return gram[order], np.log(p[order])


def _lookup(answers: pd.DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    return {lang: _sorted(g["gram"].to_numpy(), g["p"].to_numpy()) for lang, g in answers.groupby("lang", sort=False)}


def perplexity(docs: DataFrame, model: Model, most_answers: int = MOST_ANSWERS) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, lang (as given), n_chars, perplexity (per character; null without characters or model)."""
    spark, writing = docs.sparkSession, model.writing
    rows = _language(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "lang", "text")).withColumn("text_hash", F.xxhash64("text"))  # pandas would make doubles of ids next to a null
    schema = "doc_id string, text_hash long, lang string, n_chars long, loss double"
    answers = model.probabilities(materialise(_ask(rows, writing, ["lang"])))
    if answers.limit(most_answers + 1).count() <= most_answers:
        langs = [r.lang for r in answers.select("lang").distinct().orderBy("lang").collect()]
        number = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("short") if langs else F.lit(0)
        table = answers.select(number.alias("k"), "gram", "p").toArrow()
        k, gram, p = (table.column(c).to_numpy() for c in ("k", "gram", "p"))
        shared = spark.sparkContext.broadcast({lang: _sorted(gram[k == i], p[k == i]) for i, lang in enumerate(langs, 1)})
        del table, k, gram, p

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in batches:
                yield from _score_frame(frame, writing, shared.value)

        scored = rows.mapInPandas(tidy(run), schema)
    else:
        size = docs.agg(F.sum(F.char_length("text"))).first()[0] or 0
        blocks = max(1, -(-size // BLOCK_CHARS))
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")).repartition(blocks, "block")
        asked = materialise(_ask(dealt, writing, ["block", "lang"]))

        def score(texts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            return pd.concat([pd.DataFrame({"doc_id": [], "text_hash": [], "lang": [], "n_chars": [], "loss": []}), *_score_frame(texts, writing, _lookup(known))])

        scored = dealt.groupBy("block").cogroup(asked.join(answers, ["lang", "gram"]).groupBy("block")).applyInPandas(score, schema)
    value = F.when(F.col("loss").isNotNull() & ~F.isnan("loss"), F.exp("loss"))
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), "text_hash", F.when(F.col("lang") != NO_LANGUAGE, F.col("lang")).alias("lang"), "n_chars", value.alias("perplexity"))


def fit(docs: DataFrame, widths: tuple[tuple[int, int], ...] = WIDTHS) -> list[Model]:
    """A model for each width that a language of docs needs, one at least."""
    known = alphabets(docs)
    width = {lang: next(k for k, (bits, _) in enumerate(widths) if len(a) + 2 <= 1 << bits) for lang, a in known.items()}
    out = []
    for k in sorted(set(width.values())) or [0]:
        own = {lang: a for lang, a in known.items() if width[lang] == k}
        rows = docs if len(own) == len(known) else docs.filter(F.coalesce("lang", F.lit(NO_LANGUAGE)).isin(*own))
        out.append(Model(rows, widths[k][1], widths[k][0], own))
    return out


def perplexities(docs: DataFrame, models: list[Model]) -> DataFrame:
    """perplexity() of each document by the model of its language; languages that none has go with the first."""
    out, lang = None, F.coalesce("lang", F.lit(NO_LANGUAGE))
    later = [name for m in models[1:] for name in m.writing.alphabets]
    for k, model in enumerate(models):
        rows = docs if len(models) == 1 else docs.filter(lang.isin(*model.writing.alphabets) if k else ~lang.isin(*later))
        scored = perplexity(rows, model)
        out = scored if out is None else out.unionByName(scored)
    return out


def judge(docs: DataFrame, labels: DataFrame, upper: float = 0.995, lower: float | None = None, slack: float = 0.02, spread: float = 1.0, fold: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, lang, n_chars, perplexity, low and high (its limits), rejected.  labels: doc_id, quality."""
    trusted = labels.filter("quality = 1").select("doc_id").distinct()
    own = docs.join(small_side(trusted), "doc_id", "left_semi").select("doc_id", "lang", "text")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(fold)) == 0
    scored = materialise(perplexities(docs, fit(own.filter(~held))))
    held_out = scored.filter(held & F.col("perplexity").isNotNull()).join(small_side(trusted), "doc_id", "left_semi")
    at = lambda share: F.percentile_approx(F.log("perplexity"), share, 100_000)  # noqa: E731  bounded, within a 100,000th of the rank
    low = F.lit(None).cast("double") if lower is None else at(lower)
    limits = materialise(held_out.groupBy(F.col("lang").alias("_lang")).agg(low.alias("low"), at(upper).alias("high")))
    room = slack + spread / F.sqrt(F.greatest("n_chars", F.lit(1)))
    out = scored.join(limits, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang").withColumn("low", F.exp(F.col("low") - room)).withColumn("high", F.exp(F.col("high") + room))
    return out.withColumn("rejected", F.coalesce(F.col("perplexity") < F.col("low"), F.lit(False)) | F.coalesce(F.col("perplexity") > F.col("high"), F.lit(False)))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns.  A row goes with its own text, not with another of its id; rows that repeat an id and text in languages that judge them differently go together."""
    id_, text = fresh(docs, "bad_id", "bad_text")
    with scratch() as tables:  # the model, the questions and the scores
        bad = materialise(judge(docs, labels).filter("rejected").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(text)).distinct())
        tables.remove(bad)
    return docs.join(small_side(bad), F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(text)), "left_anti")
