"""Product codes of vectors with codebooks learnt exactly, in whole numbers (operator 13).

Vectors become whole numbers floor(scale * x) and are cut into equal consecutive parts.  A codebook per part position starts as that part of the vectors with the smallest ids; a round assigns every part to its nearest entry and replaces an entry by the floored mean of its parts.

Rounds are one RDD treeAggregate each over columnar NumPy blocks: a block holds some thousand vectors, dimension by dimension, in the narrowest whole type that holds them, and is written once.  Distances accumulate dimension by dimension, np.add.at adds a block's parts into an int64 tensor of sums and one of counts, and the tensors (parts * entries * dimensions, a bounded size) merge through the reduction tree.  Sums of whole numbers are exact in any order, so tasks that run again after a lost executor change nothing.

Scale: every vector is read once as a row and 7 times as part of a block; nothing is shuffled but the tensors, and the driver sees one tensor a round.  Errors by label are summed with map-side combining and joined back, by broadcast while the labels are few (counted first).

Defined cases: a vector that is null, or holds null or non-finite components, is dropped; so is one whose length is not that of the smallest id's vector among those of a length that the parts divide.  Ids repeated are vectors each, ordered by their components; null ids come last.  With fewer vectors than entries the codebooks have as many entries as there are vectors.  Components too large for 64-bit sums or distances are counted in Python's whole numbers; an error that no long holds is null.  Labels that are null are summed together; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foretell.llm.common import materialise, small_side

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
BLOCK_ROWS = 4096
DEPTH = 3
_KINDS = ("<i2", "<i4", "<i8")


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exactly; an array of Python's whole numbers where 64 bits do not hold them."""
    y = np.floor(x * float(scale))
    if len(y) and not np.abs(y).max() < 2.0**62:
        return np.array([int(Fraction(v) * scale // 1) for v in x.ravel().tolist()], object).reshape(x.shape)
    return y.astype(np.int64)


def _pack(x: np.ndarray) -> tuple[str, bytes]:
    if x.dtype == object:
        return "text", " ".join(map(str, x.ravel())).encode()
    kind = next(k for k in _KINDS if not x.size or np.abs(x).max() <= np.iinfo(k).max)
    return kind, np.ascontiguousarray(x, kind).tobytes()


def _unpack(kind: str, data: bytes, dims: int, big: bool) -> np.ndarray:
    """The block as (dimension, row)."""
    if kind == "text":
        return np.array([int(v) for v in data.split()], object).reshape(dims, -1)
    x = np.frombuffer(data, kind).reshape(dims, -1)
    return x.astype(object) if big else x.astype(np.int64)


def nearest(block: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry of codebook (entry, dimension) to each column of block (dimension, row); ties to the lower index."""
    far = np.zeros((len(codebook), block.shape[1]), block.dtype)
    for d in range(len(block)):
        gap = block[d][None, :] - codebook[:, d][:, None]
        far += gap * gap
    code = np.argmin(far, axis=0).astype(np.int64) if far.dtype != object else np.array([min(range(len(far)), key=far[:, i].__getitem__) for i in range(far.shape[1])], np.int64)
    return code, far[code, np.arange(far.shape[1])]


class Codes(NamedTuple):
    """codebooks (part, entry, dimension); codes has vec_id, label, code (list of indexes), error."""

    codebooks: np.ndarray
    codes: DataFrame


def _kept(vectors: DataFrame, parts: int) -> DataFrame:
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label").filter(F.col("embedding").isNotNull() & good)
    return rows.filter((F.size("embedding") > 0) & (F.size("embedding") % parts == 0))


def _blocks(rows: DataFrame, dims: int, scale: int) -> DataFrame:
    """The rows as columnar blocks: ids, labels, kind, data, most (largest component, as a double)."""
    label = rows.schema["label"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                b = batch.slice(lo, BLOCK_ROWS)
                x = whole(np.asarray(b.column("embedding").flatten(), np.float64).reshape(-1, dims).T, scale)
                kind, data = _pack(x)
                lists = [pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(c)) for c in ("vec_id", "label")]
                most = float(max(map(abs, x.ravel()))) if kind == "text" else float(np.abs(x).max())
                yield pa.RecordBatch.from_arrays([*lists, pa.array([kind]), pa.array([data], pa.binary()), pa.array([most])], ["ids", "labels", "kind", "data", "most"])

    id_ = rows.schema["vec_id"].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(id_)), T.StructField("labels", T.ArrayType(label)), T.StructField("kind", T.StringType()), T.StructField("data", T.BinaryType()), T.StructField("most", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def train(blocks: DataFrame, codebooks: np.ndarray, rounds: int, big: bool, depth: int = DEPTH) -> np.ndarray:
    """The codebooks (part, entry, dimension) after `rounds` rounds over the blocks."""
    parts, entries, width = codebooks.shape
    sc = blocks.sparkSession.sparkContext
    rdd = blocks.select("kind", "data").rdd.map(lambda r: _unpack(r["kind"], bytes(r["data"]), parts * width, big))
    for _ in range(rounds):
        sent = sc.broadcast(codebooks)  # parts * entries * width numbers

        def add(total: tuple[np.ndarray, np.ndarray], block: np.ndarray, sent=sent) -> tuple[np.ndarray, np.ndarray]:
            sums, counts = total
            for p in range(parts):
                own = block[p * width : (p + 1) * width]
                code, _ = nearest(own, sent.value[p])
                np.add.at(sums[p], code, own.T)
                np.add.at(counts[p], code, 1)
            return sums, counts

        zero = (np.zeros((parts, entries, width), object if big else np.int64), np.zeros((parts, entries), np.int64))
        sums, counts = rdd.treeAggregate(zero, add, lambda a, b: (a[0] + b[0], a[1] + b[1]), depth)
        used = counts > 0
        codebooks = codebooks.copy()
        codebooks[used] = sums[used] // counts[used][:, None]
        sent.destroy()
    return codebooks


def product_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes | None:
    """Codebooks, and the code and error of every vector that takes part; None if there is none."""
    rows = _kept(vectors, parts)
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    first = rows.orderBy(*order).select(F.size("embedding").alias("n")).first()
    if first is None:
        return None
    dims = first["n"]
    rows = rows.filter(F.size("embedding") == dims)
    start = np.array([r["embedding"] for r in rows.orderBy(*order).limit(entries).collect()], np.float64)  # `entries` rows
    blocks = materialise(_blocks(rows, dims, scale))
    bounds = blocks.agg(F.max("most").alias("most"), F.sum(F.size("ids")).alias("n")).first()
    big = bool(bounds["most"] * bounds["n"] >= 2.0**62 or dims * (2 * bounds["most"]) ** 2 >= 2.0**62)
    width = dims // parts
    codebooks = whole(start, scale).reshape(-1, parts, width).transpose(1, 0, 2)
    codebooks = train(blocks, codebooks.astype(object) if big else codebooks, rounds, big)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                block = _unpack(b.column("kind")[i].as_py(), b.column("data")[i].as_py(), dims, big)
                pairs = [nearest(block[p * width : (p + 1) * width], codebooks[p]) for p in range(parts)]
                code = np.stack([c for c, _ in pairs], axis=1).astype(np.int32)
                error = sum(e for _, e in pairs)
                error = pa.array([e if e < 2**63 else None for e in error], pa.int64()) if big else pa.array(error)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, code.size + 1, parts), pa.int32()), pa.array(code.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("ids")[i].values, b.column("labels")[i].values, lists, error], ["vec_id", "label", "code", "error"])

    schema = T.StructType([rows.schema["vec_id"], rows.schema["label"], T.StructField("code", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])
    return Codes(codebooks, blocks.select("ids", "labels", "kind", "data").mapInArrow(run, schema))


def codebooks_digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def errors_by_label(codes: DataFrame) -> DataFrame:
    """codes with label_error, the sum of error over rows of an equal label (null if no long holds it)."""
    codes = materialise(codes)
    total = F.sum(F.col("error").cast("decimal(20,0)"))
    unknown = F.max(F.col("error").isNull())
    sums = codes.groupBy(F.col("label").alias("_label")).agg(F.when(~unknown, total.try_cast("long")).alias("label_error"))
    return codes.join(small_side(sums), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
