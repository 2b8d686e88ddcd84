"""SimHash near-duplicates with pivot distance tables (operator 9).

Fingerprint: A-Z is lower-cased, words are `[^\\x20\\x09-\\x0D]+`, shingles are `words` consecutive words with repeats (fewer words: the whole sequence), hashed by XXH64 with seed 42; a bit is set if it is set in over half of the hashes.

Links: two fingerprints link when at most `bits` (4) bits differ.
1. Equal fingerprints collapse to one node first, however many copies there are.
2. The 64 bits are cut into 6 blocks; 4 differing bits leave two blocks untouched, so every linked pair shares the key of at least one of the 15 pairs of blocks.  No linked pair is lost, whatever the size of a bucket.
3. Inside a bucket a pivot table holds each fingerprint's Hamming distances to fixed reference fingerprints.  By the triangle inequality a pair whose largest coordinate difference exceeds `bits` cannot link and is discarded; survivors are verified.
4. A bucket yields a spanning forest of its links, never all pairs, rooted at its smallest id, so that the buckets of one group tell the same links.  Buckets of more than TILE rows are cut into pairs of tiles, so no task holds a large bucket.
5. Components of the links give component_id.  A node is (smallest doc_id, hash), so that a component's smallest node names its smallest doc_id, and nothing is joined by component.

By similarity (the pipeline: sets of five words, 0.8) fingerprints have LANES * 64 majority bits of the distinct shingles.  Sampled bits could choose the candidates only with about n ** 0.24 tables (55 at 2e5 documents, over 400 at 1e9), so buckets come from the least of the same shingle hashes instead: KEYS keys of EACH minima each, a fixed KEYS rows of about 60 bytes a document, n * KEYS rows in all.  A pair at 0.8 shares a key with probability 0.999.  In a bucket pivots and bits discard pairs beyond three standard deviations of the distance expected at the similarity, and what is left is verified by the exact similarity of the shingle sets (distinct hashes of 32 bits).  Buckets of one key come first, and those of the others look for links between what is not connected yet; what a round connects is put together before the next.  Links that fail verification may hide others, so the buckets with such links that are not of one piece are read once more, with their shingle sets: a task tests every pair of a bucket that bits do not discard and nothing connects yet, which settles it.  Of buckets beyond a tile (TILE rows, LOAD bytes of sets) each tile is settled so, then each pair of tiles of those still not of one piece.  So a document's rows are read a fixed number of times, however many links of its groups fail.

Defined cases: null and blank texts have fingerprint zero, linked like any other; whole texts are read; a null doc_id takes part but never becomes a component_id unless its group has no other; repeated rows give repeated results; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretell.llm.common import discard, few, fresh, in_lots, materialise, small_side, tidy
from foretell.llm.components import SMALL, connected_components

SEED = 42
PIVOTS = 16
TILE = 8192
#: 64-bit lanes of a wide fingerprint.
LANES = 4
#: Bucket keys of a document, and minima in each.
KEYS, EACH = 24, 6
#: Buckets of up to so many rows are treated many at a time.
FEW = 16
#: Rows of buckets, and pairs of texts, for which a task is worth its while.
LOT, PAIRS = 20_000, 2_000
#: Bytes of shingle sets in a tile, about.
LOAD = 1 << 25
#: First bit and width of the six blocks.
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
#: Stands for a null doc_id in nodes: after all others.
LAST = 2**63 - 1
#: Frequent fingerprints whose rows are settled by broadcast.
FREQUENT = 256

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_MULTIPLIERS = np.random.default_rng(SEED).integers(0, 2**31, KEYS * EACH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_COMBINE = np.random.default_rng(SEED + 1).integers(0, 2**63, EACH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 of every shingle of a UTF-8 text, repeats included; none for a text without words."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    n = max(1, len(parts) - words + 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(words, len(parts)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), dtype="<u8", count=n)


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits that are set in over half of the hashes."""
    if not len(hashes):
        return np.uint64(0)
    octets = np.ascontiguousarray(hashes).view(np.uint8).reshape(len(hashes), 8)
    counts = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0]


def fingerprint(text: bytes | None, words: int = 4) -> int:
    """The 64-bit fingerprint of a UTF-8 text as an unsigned integer."""
    return int(majority(shingle_hashes(text, words)))


def _mixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Another 64 bits for each hash (a bijective finaliser after a lane's offset); lane 0 is the hash itself."""
    if not lane:
        return hashes
    x = hashes + np.uint64(lane * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_fingerprint(hashes: np.ndarray, lanes: int = LANES) -> bytes:
    """lanes * 64 majority bits of distinct hashes."""
    return np.array([majority(_mixed(hashes, k)) for k in range(lanes)], "<u8").tobytes()


def bucket_keys(small: np.ndarray) -> np.ndarray:
    """KEYS keys of a set of 32-bit hashes, each made of EACH least values under multiplications of their own; none for the empty set."""
    if not len(small):
        return np.empty(0, np.int64)
    least = np.full(KEYS * EACH, 2**32 - 1, np.uint32)
    for at in range(0, len(small), 2048):
        least = np.minimum(least, (_MULTIPLIERS[:, None] * small[None, at : at + 2048]).min(axis=1))
    key = (least.reshape(KEYS, EACH).astype(np.uint64) * _COMBINE).sum(axis=1, dtype=np.uint64) + np.arange(KEYS, dtype=np.uint64)
    return _mixed(key, 1).view(np.int64)


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, fp (64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            fps = pa.array(np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), fps], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(in_lots(run), "doc_id long, fp long")


def sketches(docs: DataFrame, words: int = 5) -> DataFrame:
    """id, hash (of the text), fp (wide), keys, shingles (the sorted distinct 32-bit hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, keys, sets = [], [], []
            for t in b.column(2).cast(pa.binary()).to_pylist():
                hashes = np.unique(shingle_hashes(t, words))
                small = np.unique((hashes >> np.uint64(32)).astype("<u4"))
                fps.append(wide_fingerprint(hashes))
                keys.append(bucket_keys(small))
                sets.append(small.tobytes())
            columns = [b.column(0), b.column(1), pa.array(fps, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "hash", "fp", "keys", "shingles"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64("text").alias("hash"), "text")
    return rows.mapInArrow(in_lots(run), "id long, hash long, fp binary, keys array<bigint>, shingles binary")


def _to_lanes(column: pa.Array) -> np.ndarray:
    """Fingerprints as rows of unsigned 64-bit lanes."""
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, 1)
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, "<u8").reshape(len(column), -1) if len(column) else np.empty((0, LANES), np.uint64)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances (PIVOTS, n) of fingerprints to the reference fingerprints."""
    pivots = np.random.default_rng(SEED).integers(0, 2**64, (PIVOTS, fps.shape[1]), dtype=np.uint64)
    return np.stack([distance(fps, p) for p in pivots])


def near(fps: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, bits: int) -> np.ndarray:
    """Which pairs (i, j) link: discarded coordinate by coordinate, survivors verified."""
    left = np.arange(len(i))
    for row in table:
        left = left[np.abs(row[i[left]] - row[j[left]]) <= bits]
    return left[distance(fps[i[left]], fps[j[left]]) <= bits]


def forest(fps: np.ndarray, table: np.ndarray, label: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of one bucket: each member met takes in the members not met yet that it links to.  Equal labels are connected already."""
    rest = np.arange(len(fps))
    us, vs = [rest[:0]], [rest[:0]]
    while len(rest):
        open_, rest = [rest[0]], rest[1:]
        for at in open_:
            if not len(rest):
                break
            known = label[rest] == label[at]
            hit = known.copy()
            hit[near(fps, table, np.full(len(rest), at), rest, bits)] = True
            took = rest[hit & ~known]
            us.append(np.full(len(took), at))
            vs.append(took)
            open_ += rest[hit].tolist()
            rest = rest[~hit]
    return np.concatenate(us), np.concatenate(vs)


def small_forests(first: np.ndarray, size: int, fps: np.ndarray, table: np.ndarray, label: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for many buckets of one size at once, which begin at `first`: trees grow by one member a step."""
    n, place = len(first), first[:, None] + np.arange(size)
    joined = np.zeros((n, size, size), bool)
    for a in range(size):
        for b in range(a + 1, size):
            joined[near(fps, table, place[:, a], place[:, b], bits), a, b] = True
    known = label[place][:, :, None] == label[place][:, None, :]
    joined |= joined.transpose(0, 2, 1) | known
    inside, every = np.zeros((n, size), bool), np.arange(n)
    inside[:, 0] = True
    us, vs = [], []
    for _ in range(size - 1):
        open_ = (joined & inside[:, :, None] & ~inside[:, None, :]).reshape(n, -1)
        best = open_.argmax(axis=1)
        grows = open_[every, best]
        a, b = best // size, np.where(grows, best % size, inside.argmin(axis=1))
        new = grows & ~known[every, a, b]
        us.append(place[every, a][new])
        vs.append(place[every, b][new])
        inside[every, b] = True
    return np.concatenate(us), np.concatenate(vs)


def bucket_links(keys: np.ndarray, fps: np.ndarray, label: np.ndarray, bits: int, most: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked rows inside the buckets of rows sorted by key, a spanning forest each."""
    edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    sizes, firsts = np.diff(edges), edges[:-1]
    us, vs = [edges[:0]], [edges[:0]]
    shared = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= FEW), sizes))
    if len(shared):
        table = np.zeros((PIVOTS, len(fps)), np.int16)
        table[:, shared] = pivot_table(fps[shared])
        for size in range(2, FEW + 1):
            own = firsts[sizes == size]
            for at in range(0, len(own), most):
                u, v = small_forests(own[at : at + most], size, fps, table, label, bits)
                us.append(u)
                vs.append(v)
    for k in np.flatnonzero(sizes > FEW):
        own = slice(edges[k], edges[k + 1])
        if (label[own] == label[edges[k]]).all():
            continue
        u, v = forest(fps[own], pivot_table(fps[own]), label[own], bits)
        us.append(u + edges[k])
        vs.append(v + edges[k])
    return np.concatenate(us), np.concatenate(vs)


def settled_links(fps: np.ndarray, label: np.ndarray, sets: list[np.ndarray], bits: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked rows of one bucket: links between different labels that connect whatever pairs of at most `bits` differing bits and this similarity of their sets connect.  Members of small labels come first, and each is tested against all later ones that nothing connects it to yet."""
    label = np.unique(label, return_inverse=True)[1]
    place = np.lexsort((label, np.bincount(label)[label]))
    fps, label, sets = fps[place], label[place], [sets[k] for k in place]
    n = np.array([len(x) for x in sets], np.int64)
    ends = np.cumsum(n)
    number = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own = np.zeros(len(number), bool)  # whether the member at hand has a shingle
    us, vs = [], []
    for at in range(np.flatnonzero(np.r_[True, label != label[-1]])[-1]):
        rest = at + 1 + np.flatnonzero(label[at + 1 :] != label[at])
        rest = rest[distance(fps[rest], fps[at]) <= bits]
        rest = rest[np.minimum(n[rest], n[at]) >= similarity * np.maximum(n[rest], n[at])]  # else their sizes alone tell them apart
        if not len(rest):
            continue
        own[number[ends[at] - n[at] : ends[at]]] = True
        first = np.cumsum(n[rest]) - n[rest]
        both = np.add.reduceat(own[number[np.arange(n[rest].sum()) + np.repeat(ends[rest] - n[rest] - first, n[rest])]], first, dtype=np.int64)
        own[number[ends[at] - n[at] : ends[at]]] = False
        held = rest[both >= similarity * (n[at] + n[rest] - both)]
        took = held[np.unique(label[held], return_index=True)[1]]
        us.append(np.full(len(took), at))
        vs.append(took)
        label[np.isin(label, label[took])] = label[at]
    return (place[np.concatenate(us)], place[np.concatenate(vs)]) if us else (place[:0], place[:0])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of whole buckets from batches in which buckets come one after another, by their first column."""
    left: pa.Table | None = None
    for b in batches:
        new = pa.Table.from_batches([b])
        left = new if left is None else pa.concat_tables([left, new])
        key = left.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if last:
            yield left.slice(0, last)
            left = left.slice(last)
    if left is not None and len(left):
        yield left


def _told(rows: pa.Table, u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """key, u, v of links between these places of rows (key, id, hash, ...)."""
    key, id_, hash_ = (rows.column(k).combine_chunks() for k in range(3))
    node = lambda at: pa.StructArray.from_arrays([id_.take(pa.array(at)), hash_.take(pa.array(at))], ["id", "hash"])
    return pa.RecordBatch.from_arrays([key.take(pa.array(u)), node(u), node(v)], ["key", "u", "v"])


def _find(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Links inside buckets, which come one after another: key, id, hash, fp, label."""
    for rows in _whole(batches):
        key, label = (rows.column(k).to_numpy() for k in (0, 4))
        yield _told(rows, *bucket_links(key, _to_lanes(rows.column(3).combine_chunks()), label, bits))


def _settle(batches: Iterator[pa.RecordBatch], bits: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Links that hold and settle buckets, which come one after another: key, id, hash, fp, label, shingles."""
    for rows in _whole(batches):
        key, label, fps = rows.column(0).to_numpy(), rows.column(4).to_numpy(), _to_lanes(rows.column(3).combine_chunks())
        edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        us, vs = [edges[:0]], [edges[:0]]
        for a, b in zip(edges[:-1], edges[1:]):
            if (label[a:b] != label[a]).any():
                sets = [np.frombuffer(x, "<u4") for x in rows.column(5).slice(a, b - a).to_pylist()]
                u, v = settled_links(fps[a:b], label[a:b], sets, bits, similarity)
                us.append(u + a)
                vs.append(v + a)
        yield _told(rows, np.concatenate(us), np.concatenate(vs))


LINKS = "key long, u struct<id:bigint,hash:bigint>, v struct<id:bigint,hash:bigint>"


def _by_bucket(rows: DataFrame, most: int | None) -> DataFrame:
    """rows (key, id, hash, ...), at most so many if that is known, with buckets one after another."""
    dealt = rows.repartition("key")
    return (dealt if most is None else few(dealt, most, LOT)).sortWithinPartitions("key", "id", "hash")


def _found(rows: DataFrame, bits: int, most: int | None = None) -> DataFrame:
    """(key, u, v): links inside the buckets of rows (key, id, hash, fp, label), whose members are met by their ids.  most: how many rows there are at most, if that is known."""
    return _by_bucket(rows.select("key", "id", "hash", "fp", "label"), most).mapInArrow(tidy(lambda it: _find(it, bits)), LINKS)


def _settled(rows: DataFrame, bits: int, similarity: float, most: int) -> DataFrame:
    """(u, v): links that settle the buckets of rows (key, id, hash, fp, label, shingles), at most so many."""
    dealt = _by_bucket(rows.select("key", "id", "hash", "fp", "label", "shingles"), most)
    return dealt.mapInArrow(tidy(lambda it: _settle(it, bits, similarity)), LINKS).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _tile_of() -> Column:
    """The tile of a row (id, hash, tiles)."""
    return F.pmod(F.xxhash64("id", "hash"), F.col("tiles")).cast("int")


def _pairs_of_tiles(rows: DataFrame) -> DataFrame:
    """Rows of large buckets (key, tiles, ...) once for each pair of tiles of their bucket that theirs is in."""
    own = _tile_of()
    each = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return each.withColumn("key", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))


def _tiles(rows: DataFrame, tile: int, least: int) -> DataFrame:
    """key, tiles of the buckets of at least so many rows."""
    return rows.groupBy("key").count().filter(F.col("count") >= least).select("key", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))


def links(nodes: DataFrame, bits: int = 4, tile: int = TILE) -> DataFrame:
    """(u, v): links that connect what links of at most `bits` differing bits connect.  nodes: id, hash, and distinct fp of 64 bits.  bits: up to 4."""
    if bits > len(BLOCKS) - 2:
        raise ValueError(f"bits: at most {len(BLOCKS) - 2}")
    part = lambda k: f"(shiftrightunsigned(fp, {BLOCKS[k][0]}) & {(1 << BLOCKS[k][1]) - 1})"
    keys = [f"shiftleft({n}L, 56) | shiftleft({part(a)}, 24) | {part(b)}" for n, (a, b) in enumerate(combinations(range(len(BLOCKS)), 2))]
    rows = nodes.select(F.explode(F.expr(f"array({', '.join(keys)})")).alias("key"), "id", "hash", "fp", F.xxhash64("id", "hash").alias("label"))
    large = materialise(_tiles(rows, tile, tile + 1))
    if large.limit(1).count() == 0:
        return _found(rows, bits).select("u", "v")
    split = _pairs_of_tiles(rows.join(large, "key"))
    return _found(rows.join(large, "key", "left_anti"), bits).union(_found(split, bits)).select("u", "v")


def differing_share(similarity: float) -> float:
    """Expected share of differing majority bits of two texts whose shingle sets have this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """u, v, good: whether the shingle sets of a pair are as similar as that.  pairs: a written table.  A node of many pairs is read once for each of 16 parts of its partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(good, pa.bool_())], ["u", "v", "good"])

    most = pairs.count()
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(16)))
    left = pairs.select("u", "part").distinct().join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("x")), "u")
    both = pairs.join(left, ["u", "part"]).join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("y")), "v")
    node = "struct<id:bigint,hash:bigint>"
    return few(both.select("u", "v", "x", "y"), most, PAIRS).mapInArrow(tidy(run), f"u {node}, v {node}, good boolean")


def similar_components(nodes: DataFrame, texts: DataFrame, similarity: float, tile: int = TILE) -> DataFrame:
    """(node, label) of the nodes that similar pairs connect.  nodes: id, hash, fp, keys; texts: id, hash, shingles of at least these."""
    share, width = differing_share(similarity), 64 * LANES
    bits = round(width * share + 3 * math.sqrt(width * share * (1 - share)))
    rows = nodes.select(F.posexplode("keys").alias("number", "key"), "id", "hash", "fp")
    size = nodes.count()
    live = materialise(few(rows.join(_tiles(rows, tile, 2), "key"), KEYS * size))
    node = F.struct("id", "hash")
    sets = texts.join(live.select("id", "hash").distinct(), ["id", "hash"]).dropDuplicates(["id", "hash"])
    sets = materialise(few(sets.select(node.alias("node"), "shingles"), size, PAIRS))
    tested = labels = failed = settled = None

    def labelled(rows: DataFrame) -> DataFrame:
        own = F.xxhash64("id", "hash")
        if labels is None:
            return rows.withColumn("label", own)
        named = labels.select(F.col("node.id").alias("id"), F.col("node.hash").alias("hash"), F.xxhash64("label.id", "label.hash").alias("label"))
        return rows.join(small_side(named, SMALL), ["id", "hash"], "left").withColumn("label", F.coalesce("label", own))

    def apart(rows: DataFrame) -> DataFrame:
        """Keys of the buckets that are not of one piece."""
        return rows.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select("key")

    def look(rows: DataFrame, most: int) -> None:
        """Test the links found that were not tested yet in rows, at most so many."""
        nonlocal tested, failed
        found = materialise(_found(rows, bits, most).select("key", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))
        n = found.count()
        pairs = few(found.select("u", "v").distinct(), n)
        pairs = materialise(pairs if tested is None else few(pairs.join(small_side(tested.select("u", "v"), SMALL), ["u", "v"], "left_anti"), n))  # read twice
        new = materialise(_verified(pairs, sets, similarity))
        held_now = small_side(new.filter("good").select("u", "v"), SMALL)
        old, failed = failed, materialise(few(found.join(held_now, ["u", "v"], "left_anti").select("key").distinct(), n))  # what was tested before and is found again has failed
        discard(found, pairs, *([] if old is None else [old]))
        if tested is None:
            tested = new
        else:
            tested, old = materialise(tested.union(new)), tested
            discard(old, new)

    def connect() -> None:
        nonlocal labels
        good = tested.filter("good").select("u", "v")
        good = good if settled is None else good.union(settled)
        old, labels = labels, connected_components(good, good.count())
        if old is not None:
            discard(old)

    def settle(rows: DataFrame, most: int) -> None:
        nonlocal settled
        new = materialise(few(_settled(rows, bits, similarity, most), most))
        some = new.limit(1).count()
        if settled is None:
            settled = new
        else:
            settled, old = materialise(settled.union(new)), settled
            discard(old, new)
        if some:
            connect()

    tiled = F.when(F.col("tiles") > 1, F.xxhash64("key", _tile_of())).otherwise(F.col("key"))
    for rows, most in ((live.filter("number = 0"), size), (live, KEYS * size)):
        look(labelled(rows).withColumn("key", tiled), most)
        connect()  # what a round has connected, the next one's buckets need not tell again: a link that holds then is a new one
    here = live.filter("tiles = 1").join(failed, "key", "left_semi").unionByName(live.filter("tiles > 1"))  # the links of all others hold
    here = materialise(few(labelled(here), KEYS * size))
    if (most := here.count()) and (keys := apart(here)).limit(1).count():
        whole = here.drop("tiles").join(keys, "key").join(sets.select("node.id", "node.hash", "shingles"), ["id", "hash"])
        whole = materialise(few(whole, most, LOT))
        parts = whole.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum(F.octet_length("shingles")) / LOAD)).cast("int").alias("tiles"))
        parts = materialise(few(parts.filter("tiles > 1"), most))
        if not parts.limit(1).count():
            settle(whole, most)
        else:
            large = whole.join(parts, "key")
            settle(whole.join(parts, "key", "left_anti").unionByName(large.withColumn("key", F.xxhash64("key", _tile_of())).drop("tiles")), most)
            large = labelled(large.drop("label"))
            settle(_pairs_of_tiles(large.join(apart(large), "key")), most)
        discard(whole, parts)
    discard(live, sets, tested, failed, here, *([] if settled is None else [settled]))
    return labels


def spread_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left joined with right, whose key is unique.  Up to FREQUENT keys that many rows of left may hold are settled by broadcast, so that no task holds one of them."""
    top = left.agg(F.expr(f"approx_top_k(xxhash64({key}), {FREQUENT}, {FREQUENT * 8})").alias("top")).select(F.explode("top.item").alias("top"))
    few = F.broadcast(materialise(right.join(F.broadcast(top), F.xxhash64(key) == F.col("top"), "left_semi")))
    return left.join(few, key).unionByName(left.join(few.select(key), key, "left_anti").join(right, key))


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = 4) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id.  Links are fingerprints of at most `bits` differing bits."""
    own = materialise(fingerprints(docs, words))
    nodes = own.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(LAST)).alias("id")).withColumn("hash", F.col("fp"))
    nodes = materialise(nodes)
    labels = connected_components(links(nodes, bits)).select(F.col("node.hash").alias("fp"), F.col("label.id").alias("found"))
    classes = nodes.join(labels, "fp", "left").withColumn("component_id", F.coalesce("found", "id"))
    classes = materialise(classes.select("fp", F.when(F.col("component_id") < LAST, F.col("component_id")).alias("component_id")))
    return spread_join(own, classes, "fp").select("doc_id", "fp", "component_id")


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Nodes (id, hash) that stand for the different texts of docs, with their label (id, hash), the sketches (id, hash, fp) they come from, and the written tables that both are read from.  A node is its own label if its text stays."""
    own = materialise(sketches(docs, words))
    nodes = own.groupBy("fp").agg(F.min(F.struct("id", "hash")).alias("node"), F.first("keys").alias("keys")).select("node.id", "node.hash", "fp", "keys")
    nodes = materialise(few(nodes, own.count(), LOT))
    labels = similar_components(nodes, own, similarity)
    named = nodes.select("id", "hash", "fp", F.struct("id", "hash").alias("node")).join(small_side(labels, SMALL), "node", "left")
    return named.select("id", "hash", "fp", F.coalesce("label", "node").alias("label")), own, [own, nodes, labels]


def near_duplicate_texts(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per row of docs: doc_id, component_id, the smallest doc_id that links of this similarity reach."""
    classes, own, _ = similar_documents(docs, words, similarity)
    named = spread_join(own.select("id", "fp"), classes.select("fp", F.col("label.id").alias("component")), "fp")
    given = lambda c: F.when(F.col(c) < LAST, F.col(c))
    return named.select(given("id").alias("doc_id"), given("component").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Of each component of similar texts the row with the smallest doc_id (of an id with several texts, one of them; of rows repeated whole, one), with all its columns."""
    classes, _, tables = similar_documents(docs, words, similarity)
    key, text = fresh(docs, "id", "hash")
    stay = classes.filter(F.col("label") == F.struct("id", "hash")).select(F.col("id").alias(key), F.col("hash").alias(text))
    stay = materialise(few(stay, tables[1].count()))
    discard(*tables)
    out = docs.join(stay, (F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)) == F.col(key)) & (F.xxhash64("text") == F.col(text)), "left_semi")
    repeated = docs.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    return out.dropDuplicates(["doc_id", "text"]) if repeated else out
