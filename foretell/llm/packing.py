"""Best-fit packing of token sequences (operator 7): bulk-synchronous best fit.

Documents become token ids once, in the tasks; documents longer than the capacity are cut into pieces of the capacity, the first of which may be shorter.  Pieces are then packed whole.

Lengths are whole numbers of at most `capacity`, so range-sorted pieces and gaps are runs of equal values: at most `capacity` lengths, and at most `capacity` gap sizes with the intervals of sequences that have them (1,600 to 3,000 intervals at the sizes measured, as these follow from the lengths and not from the number of pieces).  A superstep is

    sweep     every length finds its successor, the smallest gap that holds it
    resolve   lengths that meet at one gap are ranked, longer first, and take its bins in that order; within a length pieces go by rank
    update    each used gap becomes the gap that is left

repeated until no gap holds a piece; then the longest lengths left open bins and the supersteps go on.  The sweeps over the two run tables take place on the driver: they have a few thousand rows whatever the input, and 130 to 1,650 supersteps were counted, of which one took 2.5 to 2.9 seconds when tried as a Spark job of joins and windows over the same tables.  What grows with the data is distributed: counting by length, the rank of every piece in its length (dealt to shards, so a length may hold any share of the rows), and placement, in which every piece finds its interval of ranks.

Ids are those of the tokenizers library's plain call.  The tasks get them from the same vocabulary read as ranks, which gives equal ids in a fifth of the time (1.7 against 7.9 seconds for 9.7 MB); texts that hold a special string of the vocabulary, which the library turns into its id, and texts with a run of LONG_RUN blanks, which the faster reader cannot do, go through the library itself.

Defined cases: null and empty texts are one piece that holds the end id alone; whole texts are encoded, whatever their length; repeated rows are packed each; ties of length go by doc_id and piece; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretell.llm.common import materialise, ranked, small_side

CAPACITY = 1024
END_ID = 2
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
LONG_RUN = 50_000


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY, ranks: str = RANKS) -> Callable[[str], list[int]]:
    """Ids of a text by a byte-level BPE, without an end id."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    with open(public_tokenizers.path(ranks), "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    quick = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    special = [t.content for t in library.get_added_tokens_decoder().values()]
    blanks = re.compile(r"\s+")

    def encode(text: str) -> list[int]:
        if any(t in text for t in special) or (len(text) >= LONG_RUN and max(map(len, blanks.findall(text)), default=0) >= LONG_RUN):
            return library.encode(text, add_special_tokens=False).ids
        return quick.encode_ordinary(text)

    return encode


def cuts(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of a document of n ids, and n."""
    return [0, *range(n % capacity or capacity, n, capacity), n]


def tokenise(docs: DataFrame, capacity: int = CAPACITY, keep_ids: bool = True, vocabulary: str = VOCABULARY, ranks: str = RANKS, place: Column | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, on demand, ids and the document's place (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks)
        for b in batches:
            out: list[tuple] = []
            for doc_id, text, *rest in zip(*[c.to_pylist() for c in b.columns]):
                ids = np.array([*encode(text or ""), END_ID], dtype="<u4")
                at = cuts(len(ids), capacity)
                for piece, (lo, hi) in enumerate(zip(at, at[1:])):
                    own = ids[lo:hi]
                    out.append((doc_id, piece, lo, hi - lo, zlib.crc32(own.tobytes()), *([own.astype(np.int32)] if keep_ids else []), *rest))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int32())] if keep_ids else []), *([pa.string()] if placed else [])]
            columns = list(zip(*out)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    placed = place is not None
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else []), *(["place"] if placed else [])]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "") + (", place string" if placed else "")
    return docs.select(F.col("doc_id").cast("long"), "text", *([place.alias("place")] if placed else [])).mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Run intervals (length, first rank, ranks, first sequence, offset) of a best-fit packing of counts[length] pieces."""
    left = {n: c for n, c in counts.items() if c}
    placed = dict.fromkeys(left, 0)
    gaps: dict[int, list[list[int]]] = {}
    out, sequences = [], 0

    def put(length: int, first: int, count: int, room: int) -> None:
        out.append((length, placed[length], count, first, capacity - room))
        placed[length] += count
        left[length] -= count
        if not left[length]:
            del left[length]
        if room > length:
            gaps.setdefault(room - length, []).append([first, count])

    while left:
        sizes = sorted(gaps)
        wanted: dict[int, list[int]] = {}
        for length in sorted(left, reverse=True):
            at = bisect_left(sizes, length)
            if at < len(sizes):
                wanted.setdefault(sizes[at], []).append(length)
        if not wanted:
            longest = max(left)
            for length in [n for n in sorted(left, reverse=True) if 2 * n > capacity] or [longest]:
                count = -(-left[length] // (capacity // length))
                put(length, sequences, count, capacity)
                sequences += count
            continue
        for room, lengths in wanted.items():
            bins = gaps.pop(room)
            for length in lengths:
                while bins and length in left:
                    first, count = bins.pop()
                    used = min(count, left[length])
                    put(length, first, used, room)
                    if used < count:
                        bins.append([first + used, count - used])
            if bins:
                gaps.setdefault(room, []).extend(bins)
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (doc_id, piece, length up to capacity, ...) with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    runs = spark.createDataFrame(plan(counts, capacity), "_length long, _first long, _count long, _sequence long, offset long")  # a few thousand rows
    placed = ranked(pieces, "length", ["doc_id", "piece"])
    within = (F.col("length") == F.col("_length")) & (F.col("rank") >= F.col("_first")) & (F.col("rank") < F.col("_first") + F.col("_count"))
    joined = placed.join(small_side(runs), within)
    return joined.withColumn("sequence_id", F.col("_sequence") + F.col("rank") - F.col("_first")).select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, keep_ids: bool = False, place: Column | None = None) -> DataFrame:
    """The packed pieces of docs.  With `place` (a text that sorts like the order of the documents) sequences come in the order of their first document's place."""
    packed = pack(materialise(tokenise(docs, capacity, keep_ids, place=place)), capacity)
    if place is None:
        return packed
    packed = materialise(packed)
    first = packed.groupBy("sequence_id").agg(F.min("place").alias("first_place"))
    ordered = packed.join(first, "sequence_id").repartitionByRange("first_place", "sequence_id").sortWithinPartitions("first_place", "sequence_id", "offset")
    return ordered.select(*[c for c in packed.columns if c != "place"])
