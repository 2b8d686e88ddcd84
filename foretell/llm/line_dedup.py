"""Reversible line deduplication (operator 12): sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line stripped of `[\\x20\\x09-\\x0D]` at both ends with A-Z lower-cased; keys of at least `least_chars` code points count, by 128 bits: their XXH64 with seed 42, and their XXH64 with the first as its seed.  A LineIndex holds, as written tables:

    references  (doc_id, k1, k2): which document holds which key, once each
    counts      (k1, k2, refs, least): exact number of documents that hold a key, and the smallest
    filters     (shard, filter): a cuckoo filter per shard of keys, in which a key stands once for its first document and once more for its second

A filter answers "may be known" (a copy) and "may be repeated" (two copies) without a false no, and so keeps the exact tables out of the way: `insert` looks up only keys of the new documents that may be known, `repeated` only lines that may be repeated.  The exact tables settle what the filters let through.  `delete` takes references away, lowers counts, finds the next smallest holder where the smallest goes, and removes the copies that no longer stand for a document; inserting and deleting the same documents in any order leaves the same counts and answers.

Scale: keys are cut out where the texts are read.  A shard has KEYS_PER_SHARD keys on average, so filters have a bounded size however many there are; the number of shards grows with the keys, and filters are built anew from counts when it must.  Counts are map-side combined.  Questions are dealt by shard and salt and stream past their filter in Arrow batches, so a key may be in any number of documents; keys with more than 1/HEAVY of all references (HEAVY at most) meet their lines by broadcast, the others in a join.

Defined cases: null and empty texts are one empty line; rows that repeat a doc_id are one document (a key in both is in one document, and both rows lose or keep it alike); a null doc_id is an id of its own, the smallest; other columns are ignored, whatever their names; an empty table gives an empty result.  Inserting an id that the index holds already adds to that document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foretell.llm.common import BLANKS, materialise
from foretell.llm.cuckoo import CuckooFilter, Full

LEAST_CHARS = 10
KEYS_PER_SHARD = 100_000
HEAVY = 1024
SALTS = 8
KEY = ["k1", "k2"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TO_LOWER = str.maketrans(_UPPER, _LOWER)


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(BLANKS)), _UPPER, _LOWER)


def references(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, k1, k2: every key of a row once (documents of several rows may repeat one)."""
    keys = F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1), line_key)
    digest = F.transform(F.filter(keys, lambda k: F.char_length(k) >= least_chars), lambda k: F.struct(F.xxhash64(k).alias("k1"), F.xxhash64(k, k).alias("k2")))
    return docs.select("doc_id", F.inline(F.array_distinct(digest)))


def _shard(shards: int) -> Column:
    return F.pmod(F.col("k1"), F.lit(shards)).cast("int")


def _copies(refs: Column) -> Column:
    return F.least(F.coalesce(refs, F.lit(0)), F.lit(2)).cast("int")


class LineIndex:
    """An index of lines; insert, delete and repeated are its operations.  Its tables are those of the last operation."""

    def __init__(self, spark: SparkSession, least_chars: int = LEAST_CHARS, keys_per_shard: int = KEYS_PER_SHARD):
        self.spark, self.least_chars, self.keys_per_shard, self.shards = spark, least_chars, keys_per_shard, 0
        self.references = self.counts = self.filters = None

    def insert(self, docs: DataFrame) -> LineIndex:
        """Add documents."""
        found = references(docs, self.least_chars)
        if self.references is not None or docs.groupBy("doc_id").count().filter("count > 1").limit(1).count():
            found = found.distinct()
        if self.references is None:
            self.references = materialise(found)
            self.counts = materialise(_count(self.references))
            self._build()
            return self
        ids = docs.select(F.col("doc_id").alias("_id")).distinct()
        before = self.references.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select(F.col("doc_id").alias("_id"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2"))
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))
        new = materialise(found.join(before, same, "left_anti"))
        added = materialise(_count(new))
        known = materialise(self._ask(added.select(*KEY), 1))
        old = self.counts.join(known, KEY, "left_semi").withColumnsRenamed({"refs": "old_refs", "least": "old_least"})
        both = materialise(added.join(old, KEY, "left"))
        refs = F.col("refs") + F.coalesce("old_refs", F.lit(0))
        merged = both.select(*KEY, refs.alias("refs"), F.when(F.col("old_least").isNull(), F.col("least")).otherwise(F.least("least", "old_least")).alias("least"))
        changes = both.select(*KEY, _copies(F.col("old_refs")).alias("before"), _copies(refs).alias("after"))
        return self._moved(self.references.unionByName(new), self.counts.join(both.filter("old_refs is not null").select(*KEY), KEY, "left_anti").unionByName(merged), changes)

    def delete(self, ids: DataFrame) -> LineIndex:
        """Take away the documents whose doc_id is in ids."""
        if self.references is None:
            return self
        ids = ids.select(F.col("doc_id").alias("_id")).distinct()
        same = F.col("doc_id").eqNullSafe(F.col("_id"))
        gone = self.references.join(ids, same, "left_semi")
        left = self.references.join(ids, same, "left_anti")
        touched = materialise(gone.select(*KEY).distinct())
        still = materialise(_count(left.join(touched, KEY, "left_semi")))
        old = self.counts.join(touched, KEY, "left_semi").select(*KEY, F.col("refs").alias("old_refs"))
        changes = old.join(still, KEY, "left").select(*KEY, _copies(F.col("old_refs")).alias("before"), _copies(F.col("refs")).alias("after"))
        return self._moved(left, self.counts.join(touched, KEY, "left_anti").unionByName(still), changes)

    def repeated(self, docs: DataFrame | None = None) -> DataFrame:
        """doc_id, k1, k2: keys of docs (of the index's own documents, if none are given) that other documents of the index hold too, but those of the smallest holder."""
        asked = references(docs, self.least_chars) if docs is not None else self.references
        if self.references is None:
            return asked.limit(0)
        few = self.counts.filter("refs >= 2")
        total = self.counts.agg(F.sum("refs")).first()[0] or 0
        heavy = F.broadcast(materialise(few.filter(F.col("refs") > total / HEAVY)))  # HEAVY rows at most, as refs add up to the total
        light = few.filter(F.col("refs") <= total / HEAVY)
        often = asked.join(heavy, KEY)
        rest = self._ask(asked.join(heavy.select(*KEY), KEY, "left_anti"), 2)
        found = often.unionByName(rest.join(light, KEY))
        return found.filter(~F.col("doc_id").eqNullSafe(F.col("least.doc_id"))).select("doc_id", *KEY)

    def drop_repeated(self, docs: DataFrame, own: bool = False) -> DataFrame:
        """doc_id, n_lines, n_dropped, kept_text: the whole texts of docs without their repeated lines.  own: docs are those that the index holds, and their keys are taken from there."""
        lost = self.repeated(None if own else docs).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set(F.struct(*KEY)).alias("lost"))
        lost = lost.select("_id", F.col("lost.k1").alias("lost1"), F.col("lost.k2").alias("lost2"))
        rows = docs.select("doc_id", "text").join(lost, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", "text", "lost1", "lost2")
        id_ = docs.schema["doc_id"].dataType.simpleString()
        return rows.mapInArrow(_without, f"doc_id {id_}, n_lines long, n_dropped long, kept_text string")

    def _build(self) -> None:
        """Filters anew from counts."""
        keys = self.counts.count()
        self.shards = 1 << max(0, int(np.ceil(np.log2(max(1, keys) / self.keys_per_shard))))
        rows = self.counts.select(_shard(self.shards).alias("shard"), "k2", F.lit(0).alias("before"), _copies(F.col("refs")).alias("after"))
        self.filters = materialise(rows.groupBy("shard").applyInPandas(lambda key, new: _updated(key, new, None), "shard int, filter binary"))

    def _moved(self, references: DataFrame, counts: DataFrame, changes: DataFrame) -> LineIndex:
        """The index with new tables, and filters by what changed: (k1, k2, before, after) copies."""
        changes = materialise(changes)
        self.references, self.counts = materialise(references), materialise(counts)
        if self.counts.count() > 2 * self.keys_per_shard * self.shards:
            self._build()
            return self
        rows = changes.select(_shard(self.shards).alias("shard"), "k2", "before", "after")
        moved = self.filters.groupBy("shard").cogroup(rows.groupBy("shard")).applyInPandas(lambda key, old, new: _updated(key, new, old), "shard int, filter binary")
        moved = materialise(moved)
        crowded = moved.filter("filter is null").select("shard")
        if crowded.limit(1).count():  # those shards from their counts, with more room
            own = self.counts.select(_shard(self.shards).alias("shard"), "k2", F.lit(0).alias("before"), _copies(F.col("refs")).alias("after"))
            again = own.join(crowded, "shard", "left_semi").groupBy("shard").applyInPandas(lambda key, new: _updated(key, new, None), "shard int, filter binary")
            moved = materialise(moved.filter("filter is not null").unionByName(again))
        self.filters = moved
        return self

    def _ask(self, rows: DataFrame, copies: int) -> DataFrame:
        """The rows (k1, k2, ...) whose key may stand in the filters so many times."""
        others = [c for c in rows.columns if c not in KEY]
        salt = F.pmod(F.xxhash64(*others) if others else F.lit(0), F.lit(SALTS)).cast("int")
        asked = rows.select(_shard(self.shards).alias("shard"), salt.alias("salt"), F.lit(None).cast("binary").alias("filter"), *KEY, *others)
        filters = self.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1 if others else 0))).alias("salt"), "filter")
        dealt = filters.unionByName(asked, allowMissingColumns=True).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("filter").isNull())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, own = None, None
            for b in batches:
                shard, salt = b.column("shard").to_numpy(), b.column("salt").to_numpy()
                ends = np.flatnonzero(np.r_[(shard[1:] != shard[:-1]) | (salt[1:] != salt[:-1]), True]) + 1 if len(shard) else []
                lo = 0
                for hi in map(int, ends):
                    part = b.slice(lo, hi - lo)
                    if at != (shard[lo], salt[lo]):
                        at, own = (shard[lo], salt[lo]), None
                    if part.column("filter")[0].is_valid:
                        own, part = CuckooFilter.from_bytes(part.column("filter")[0].as_py()), part.slice(1)
                    lo = hi
                    if own is not None and part.num_rows:
                        may = own.copies(part.column("k2").to_numpy()) >= copies
                        yield part.filter(pa.array(may)).select([*KEY, *others])

        return dealt.mapInArrow(run, asked.select(*KEY, *others).schema)


def _count(rows: DataFrame) -> DataFrame:
    """The exact counts of references; `least` is a struct, in which a null id comes first."""
    return rows.groupBy(*KEY).agg(F.count("*").alias("refs"), F.min(F.struct("doc_id")).alias("least"))


def _updated(key: tuple, new: pd.DataFrame, old: pd.DataFrame | None) -> pd.DataFrame:
    """A shard's filter after its changes; null if they found no room."""
    shard = int(key[0])
    hashed = new["k2"].to_numpy(np.int64)
    step = (new["after"] - new["before"]).to_numpy(np.int64)
    more, less = np.repeat(hashed, np.maximum(step, 0)), np.repeat(hashed, np.maximum(-step, 0))
    if old is None or not len(old):
        return pd.DataFrame({"shard": [shard], "filter": [CuckooFilter.of(more, len(more) * 5 // 4).to_bytes()]})
    own = CuckooFilter.from_bytes(old["filter"].iloc[0])
    own.remove(less)
    try:
        own.add(more)
    except Full:
        return pd.DataFrame({"shard": pd.Series([shard], dtype="int32"), "filter": [None]})
    return pd.DataFrame({"shard": [shard], "filter": [own.to_bytes()]})


def _without(batches: Iterator[pa.RecordBatch], lot: int = 256) -> Iterator[pa.RecordBatch]:
    hash_ = xxhash.xxh64_intdigest
    for batch in batches:
        for first in range(0, batch.num_rows, lot):
            b = batch.slice(first, lot)
            counts, dropped, texts = [], [], []
            for text, *lost in zip(*[b.column(c).to_pylist() for c in ("text", "lost1", "lost2")]):
                text = text or ""
                n = whole = text.count("\n") + 1
                if lost[0]:
                    keys, kept = set(zip(*lost)), []
                    for line in text.split("\n"):
                        own = line.strip(BLANKS).translate(_TO_LOWER).encode()
                        one = hash_(own, 42)
                        if (_signed(one), _signed(hash_(own, one))) not in keys:
                            kept.append(line)
                    text, n = "\n".join(kept), len(kept)
                counts.append(whole)
                dropped.append(whole - n)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_text"])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def drop_repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """docs inserted into a new index, and then each without its repeated lines: doc_id, n_lines, n_dropped, kept_text."""
    return LineIndex(docs.sparkSession, least_chars).insert(docs).drop_repeated(docs, own=True)
