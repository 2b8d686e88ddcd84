"""Exact top-k inner-product search with a vector-approximation file (operator 3).

Components become whole numbers floor(256 * x).  The approximation of a vector has one byte a component: the number of its cell among CELLS cells of that dimension.  Inner borders of cells are quantiles of the dimension over a sample of at most FIT vectors (smallest hashed ids); the outer ones are the least and largest component of all vectors, so every component lies in its cell and one far component widens one cell only.

1. Equal vectors are one class; only the k + 1 smallest ids of a class can appear in a result, so a class keeps these (found map-side first) and is scanned once.
2. Scan: blocks of approximations meet blocks of queries.  A cell's centre and half width bound every inner product from both sides; a block keeps, for each query, the classes whose upper bound reaches the kth best lower bound.  Blocks are scanned in rounds, each WIDER times as many as all before, and a round starts from the bounds of those before it, so a query keeps about k * WIDER classes a round, not k a block.
3. Read: the candidates with the best bounds are read exactly first, which gives a kth exact score; the others are read in the same order of bounds as far as theirs reach it, where the result is certain.

Every group has at most about VECTORS + QUERIES rows (by hashed ids), whatever the size of the tables; the query set meets all rows in blocks.  The table of cells, one row a dimension, is all that goes to every task.

Defined cases: null vectors and vectors holding null or non-finite components take no part, nor do empty ones and rows with a null id; vectors of different lengths do not meet; an id that repeats counts once, with its smallest vector; ties go to the smaller vec_id; queries with fewer than k others get what there is; a score beyond the range of long stands at that range's end; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foretell.llm.common import materialise

VECTORS, QUERIES = 2048, 1024
SCALE = 256
CELLS, FIT, WIDER = 256, 20_000, 7
#: Products and sums of doubles below this are safe as longs.
MOST = 9.0e18


def whole(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of long): the vectors that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite)
    return good.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(SCALE) * x.cast("double")).cast("long")).alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def cells(classes: DataFrame) -> dict[int, np.ndarray]:
    """By length of the vectors: borders (dimensions, CELLS + 1) of the cells, a cell holding components from its lower border to its upper one."""
    dim = F.size("v").alias("dim")
    ends = classes.select(dim, F.posexplode("v").alias("at", "x")).groupBy("dim", "at").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    few = classes.orderBy(F.xxhash64("class"), "class").limit(FIT).select(dim, F.posexplode("v").alias("at", "x"))
    inner = few.groupBy("dim", "at").agg(F.percentile_approx("x", F.array(*[F.lit(k / CELLS) for k in range(1, CELLS)]), 4 * CELLS).alias("inner"))
    out: dict[int, list[np.ndarray]] = {}
    for r in ends.join(inner, ["dim", "at"], "left").orderBy("dim", "at").collect():  # a row a dimension
        middle = np.clip(np.array(r["inner"] if r["inner"] is not None else [r["low"]] * (CELLS - 1), np.int64), r["low"], r["high"])
        out.setdefault(r["dim"], []).append(np.concatenate([[r["low"]], middle, [r["high"]]]))
    return {k: np.array(v) for k, v in out.items()}


def approximations(classes: DataFrame, borders: dict[int, np.ndarray]) -> DataFrame:
    """class, dim and approx (a byte a component) of classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            coded = []
            for v in b.column(1).to_pylist():
                own = borders[len(v)]
                coded.append(np.array([np.searchsorted(own[i, 1:-1], x, side="right") for i, x in enumerate(v)], np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, coded), pa.int32()), pa.array(coded, pa.binary())], ["class", "dim", "approx"])

    return classes.select("class", "v").mapInArrow(run, "class long, dim int, approx binary")


def scan(approx: DataFrame, queries: DataFrame, k: int, borders: dict[int, np.ndarray]) -> DataFrame:
    """(query, class, upper, lower): bounds of the classes that cannot be excluded.  queries: class, v."""
    spark = approx.sparkSession
    n_v, n_q = (max(1, -(-df.count() // most)) for df, most in ((approx, VECTORS), (queries, QUERIES)))
    deal = lambda n: F.pmod(F.xxhash64("class"), F.lit(n)).cast("int")
    left = approx.select("class", "dim", "approx", deal(n_v).alias("vb")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    asked = queries.select("class", F.size("v").alias("dim"), "v", deal(n_q).alias("qb"))
    shared = spark.sparkContext.broadcast({d: ((b[:, :-1] + b[:, 1:]) / 2, (b[:, 1:] - b[:, :-1]) / 2) for d, b in borders.items()})

    def bounds(vs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(vs) and len(qs):
            dim = int(vs["dim"].iloc[0])
            codes = np.frombuffer(b"".join(vs["approx"]), np.uint8).reshape(len(vs), dim)
            centres, halves = (t[np.arange(dim), codes] for t in shared.value[dim])
            ask = np.array(qs["v"].tolist(), dtype=np.float64)
            middle, slack = ask @ centres.T, np.abs(ask) @ halves.T
            slack += 1e-12 * (np.abs(ask) @ (np.abs(centres) + halves).T)  # beyond what rounding can do
            ids, n = vs["class"].to_numpy(), min(k, len(vs))
            lower, upper = middle - slack, middle + slack
            kth = np.partition(lower, len(vs) - n, axis=1)[:, len(vs) - n]
            if n < k:
                kth = np.full(len(qs), -np.inf)
            kth = np.fmax(kth, qs["kth"].to_numpy(np.float64))
            i, j = np.nonzero(upper >= kth[:, None])
            out.append(pd.DataFrame({"query": qs["class"].to_numpy()[i], "class": ids[j], "upper": upper[i, j], "lower": lower[i, j]}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "class": [], "upper": [], "lower": []})

    key = ["vb", "qb", "dim"]
    found, first, size = None, 0, 1
    kth = asked.select(F.col("class").alias("query"), F.lit(None).cast("double").alias("kth"))
    while first < n_v:
        blocks = F.explode(F.sequence(F.lit(first), F.lit(min(first + size, n_v) - 1)))
        right = asked.join(kth, F.col("class") == F.col("query"), "left").drop("query").withColumn("vb", blocks)
        part = left.filter(F.col("vb").between(first, first + size - 1))
        new = materialise(part.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(bounds, "query long, class long, upper double, lower double"))
        found = new if found is None else found.unionByName(new)
        best = found.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("lower"), "class")))
        kth = materialise(best.filter(F.col("n") == k).select("query", F.col("lower").alias("kth")))
        first += size
        size = WIDER * first
    return found.join(kth, "query", "left").filter(F.col("kth").isNull() | (F.col("upper") >= F.col("kth"))).drop("kth")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of vectors other than the query's own with the largest inner products.  queries: vec_id, a subset of vectors."""
    rows = whole(vectors)
    near = Window.partitionBy("v").orderBy("vec_id")
    members = rows.withColumn("n", F.row_number().over(near)).filter(F.col("n") <= k + 1)
    classes = materialise(members.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("class", F.col("ids")[0]))
    asking = rows.join(queries.select("vec_id").distinct(), "vec_id").select(F.col("vec_id").alias("query_id"), "v")
    asking = materialise(asking.join(classes.select("v", "class"), "v").select("query_id", "class"))
    ask = classes.join(asking.select("class").distinct(), "class").select("class", "v")
    borders = cells(classes)
    found = materialise(scan(materialise(approximations(classes, borders)), ask, k + 1, borders))
    total = lambda kind, size: F.aggregate(F.zip_with("q", "v", lambda a, b: size(a.cast(kind) * b.cast(kind))), F.lit(0).cast(kind), lambda s, x: s + x)
    whole_sum, about = total("long", lambda x: x), total("double", lambda x: x)
    exact = F.when(total("double", F.abs) < MOST, whole_sum).when(about > 0, F.lit(2**63 - 1)).otherwise(F.lit(-(2**63)))

    def read(pairs: DataFrame) -> DataFrame:
        own = pairs.join(classes.select("class", "v"), "class").join(ask.select(F.col("class").alias("query"), F.col("v").alias("q")), "query")
        return own.select("query", "class", exact.alias("score"))

    order = Window.partitionBy("query").orderBy(F.desc("upper"), "class")
    placed = found.withColumn("n", F.row_number().over(order))
    first = materialise(read(placed.filter(F.col("n") <= k + 1)))
    kth = first.groupBy("query").agg(F.min("score").alias("kth"))
    later = placed.filter(F.col("n") > k + 1).join(kth, "query").filter(F.col("upper") >= F.col("kth"))
    scored = first.unionByName(read(later))
    best = scored.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "class"))).filter(F.col("n") <= k + 1)
    named = best.join(classes.select("class", "ids"), "class").select("query", "score", F.explode("ids").alias("vec_id"))
    named = named.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).filter(F.col("n") <= k + 1)
    mine = asking.join(named.drop("n"), F.col("class") == F.col("query")).filter("vec_id <> query_id")
    ranked = mine.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
