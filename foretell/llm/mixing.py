"""Mixing sources to target weights by Pfair scheduling (operator 1).

Rows of a source form blocks of equal size in a fixed order.  With target weight w, block k (from 1) of a source is released at slot floor((k - 1) / w) and due by slot ceil(k / w); earliest deadline first, among released blocks, fills one slot after another.  Releases and deadlines come from the exact fractions of the targets, never from rounded shares, so at every slot a source has had w * slots blocks, give or take less than one, however long the mix.  When a source runs out the others share in proportion to their weights from the next slot on, released and due as from a new start; no row is dropped or repeated.

Scale: ranks within a source are dealt to shards, so a source may hold any share of the rows, and each row finds its block's slot by a join on (source, block).  Blocks have the same size whatever the table.  Up to SLOTS slots are scheduled on the driver.  More are cut into slices of as many slots, which are scheduled in tasks: a slice begins WARM slots early from the state that gives the blocks begun but not due to the earliest deadlines (each source has had its exact share, rounded down or up, so deadlines can be met from there on), and from it the schedule falls in with the one from the start.  That is verified: a slice must begin in the state in which the one before it ended, else all are run again from further back, at last from the start.  So slices yield the very schedule that one loop would.

Defined cases: a null source is a source of its own; a source without a weight, or with a weight of zero or less, gets the smallest positive weight; null and repeated rows are scheduled like any other, ties of doc_id by the text's hash; other columns are kept by `mix`, whatever their names, and ignored by the schedule; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foretell.llm.common import discard, fresh, materialise, ranked

BLOCK = 16
SLOTS, WARM = 1 << 20, 1 << 14


def whole_weights(weights: list[float]) -> list[int]:
    """Whole numbers in the exact proportion of the weights, those that are missing or not positive as the smallest one that is."""
    given = [Fraction(w) if w and w > 0 else None for w in weights]
    least = min((w for w in given if w), default=Fraction(1))
    given = [w or least for w in given]
    scale = math.lcm(*[w.denominator for w in given])
    return [int(w * scale) for w in given]


def follow(blocks: list[int], weights: list[int], had: list[int], start: int, slots: int) -> tuple[np.ndarray, bool]:
    """The sources of the next slots, earliest deadline first, from a state: blocks that each source has had by slot `start`.  `had` is brought up to the end.  It ends early with the slot in which a source gives its last block, which the flag says."""
    total, out = sum(weights), np.empty(slots, np.int32)
    waiting, ready = [(n * total // w, i) for i, (n, w) in enumerate(zip(had, weights))], []
    heapq.heapify(waiting)
    for k in range(slots):
        while waiting and waiting[0][0] <= start + k:
            _, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(had[i] + 1) * total // weights[i]), i))
        _, i = heapq.heappop(ready)
        out[k] = i
        had[i] += 1
        heapq.heappush(waiting, (had[i] * total // weights[i], i))
        if had[i] == blocks[i]:
            return out[: k + 1], True
    return out, False


def earliest_deadline_first(blocks: list[int], weights: list[int]) -> np.ndarray:
    """The source of each slot."""
    left, parts = list(blocks), [np.empty(0, np.int32)]
    while sum(left):
        active = [i for i, n in enumerate(left) if n]
        had = [0] * len(active)
        found, _ = follow([left[i] for i in active], [weights[i] for i in active], had, 0, sum(left))
        parts.append(np.array(active, np.int32)[found])
        for i, n in zip(active, had):
            left[i] -= n
    return np.concatenate(parts)


def schedule(blocks: list[int], weights: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Source and block (from 0 in its source) of each slot."""
    source = earliest_deadline_first(blocks, whole_weights(weights))
    block = np.empty(len(source), np.int64)
    for i, n in enumerate(blocks):
        block[source == i] = np.arange(n)
    return source, block


def border(weights: list[int], t: int) -> list[int]:
    """A state at slot t from which every deadline can be met: each source has had its share, rounded down, and those whose next block is due first have had it too."""
    total = sum(weights)
    had = [w * t // total for w in weights]
    open_ = sorted((-(-(n + 1) * total // w), i) for i, (n, w) in enumerate(zip(had, weights)) if w * t % total)
    for _, i in open_[: t - sum(had)]:
        had[i] += 1
    return had


_SLICE = "slice long, source int, block long, slot long"


def _slices(spark: SparkSession, blocks: list[int], weights: list[int], horizon: int, slots: int, warm: int) -> DataFrame:
    """slice, source, block, slot for the slots up to the horizon; and for each slice a row with source -1 that holds hashes of the states it began and ended in, and one with source -2 that holds whether a source ended and the slots done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.column(0).to_pylist():
                start = s * slots
                early = max(0, start - warm)
                had = border(weights, early)
                follow([2 * n + 2 for n in blocks], weights, had, early, start - early)  # nothing ends on the way
                begun = list(had)
                over = any(n >= m for n, m in zip(had, blocks))  # a source ended before: this slice will not count
                order, ended = (np.empty(0, np.int32), False) if over else follow(blocks, weights, had, start, min(slots, horizon - start))
                number = np.empty(len(order), np.int64)
                for i in np.unique(order):
                    at = np.flatnonzero(order == i)
                    number[at] = begun[i] + np.arange(len(at))
                n = len(order)
                columns = [np.full(n + 2, s), np.r_[order, -1, -2].astype(np.int32), np.r_[number, _state(begun), int(ended)].astype(np.int64), np.r_[start + np.arange(n), _state(had), n].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["slice", "source", "block", "slot"])

    count = -(-horizon // slots)
    return spark.range(0, count, 1, count).mapInArrow(run, _SLICE)


def _state(had: list[int]) -> int:
    return xxhash.xxh64_intdigest(",".join(map(str, had)).encode()) >> 1


def plan_slots(spark: SparkSession, blocks: list[int], targets: list[float], slots: int = SLOTS, warm: int = WARM) -> DataFrame:
    """source (its place in blocks), block, slot: the schedule of all blocks."""
    weights, left, done, start, out = whole_weights(targets), list(blocks), [0] * len(blocks), 0, None
    while sum(left) > slots:
        active = [i for i, n in enumerate(left) if n]
        own, w = [left[i] for i in active], [weights[i] for i in active]
        total = sum(w)
        horizon = min(sum(own), min(-(-n * total // x) for n, x in zip(own, w)))  # by then a source has ended
        back = warm
        while True:
            rows = materialise(_slices(spark, own, w, horizon, slots, back))
            said = rows.filter("source < 0").orderBy("slice", F.desc("source")).collect()  # two rows a slice
            states, ends = said[::2], said[1::2]
            last = next((k for k, r in enumerate(ends) if r["block"]), len(ends) - 1)
            if all(states[k]["slot"] == states[k + 1]["block"] for k in range(last)) or back >= horizon:
                break
            discard(rows)
            back = 16 * max(1, back)
        place = F.array(*map(F.lit, active))
        moved = F.array(*[F.lit(done[i]) for i in active])
        kept = rows.filter((F.col("source") >= 0) & (F.col("slice") <= last))
        part = kept.select(F.get(place, F.col("source")).alias("source"), (F.col("block") + F.get(moved, F.col("source"))).alias("block"), (F.col("slot") + start).alias("slot"))
        out = part if out is None else out.unionByName(part)
        for i, n in kept.groupBy("source").count().collect():  # a row a source
            left[active[i]] -= n
            done[active[i]] += n
        start += int(ends[last]["slice"]) * slots + int(ends[last]["slot"])
    source, block = schedule(left, targets)
    rest = spark.createDataFrame(pa.table({"source": source, "block": block + np.array(done, np.int64)[source], "slot": start + np.arange(len(source))}))
    return rest if out is None else out.unionByName(rest)


def mixed_positions(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK, slots: int = SLOTS) -> DataFrame:
    """One row per row of docs: doc_id, source, text_hash, block (from 0 in its source), slot (the block's place in the mix), position (grows with the row's place; a source's last block may leave a gap).

    weights: target weight by source; by default the square root of each source's rows.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"))
    ranks = materialise(ranked(rows, "source", ["doc_id", "text_hash"]))
    sizes = ranks.groupBy("source").count().orderBy(F.col("source").asc_nulls_first()).collect()  # one row a source
    targets = [math.sqrt(r["count"]) if weights is None else weights.get(r["source"], 0.0) for r in sizes]
    names = spark.createDataFrame([(k, r["source"]) for k, r in enumerate(sizes)], "place int, name string")
    plan = plan_slots(spark, [-(-r["count"] // block) for r in sizes], targets, slots).select(F.col("source").alias("place"), F.col("block").alias("number"), "slot").join(names, "place").drop("place")
    placed = ranks.withColumn("block", F.floor(F.col("rank") / block)).join(plan, F.col("source").eqNullSafe(F.col("name")) & (F.col("block") == F.col("number")))
    return placed.select("doc_id", "source", "text_hash", "block", "slot", (F.col("slot") * block + F.col("rank") % block).alias("position"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK, slots: int = SLOTS) -> DataFrame:
    """docs in the order of the mix, with all their columns.  Equal rows are told apart by a number on both sides of the join."""
    text, number, id_, hash_, source, position, other = fresh(docs, "text_hash", "number", "mixed_id", "mixed_hash", "mixed_source", "mixed_position", "mixed_number")
    order = mixed_positions(docs, weights, block, slots).select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("source").alias(source), F.col("position").alias(position))
    order = order.withColumn(other, F.row_number().over(Window.partitionBy(id_).orderBy(hash_, source, position)))
    own = docs.withColumn(text, F.xxhash64("text"))
    own = own.withColumn(number, F.row_number().over(Window.partitionBy("doc_id").orderBy(text, "source")))
    joined = own.join(order, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(number) == F.col(other)))
    return joined.repartitionByRange(F.col(position)).sortWithinPartitions(position).select(*[F.col(f"`{c}`") for c in docs.columns])
