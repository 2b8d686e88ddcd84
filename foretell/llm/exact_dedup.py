"""Exact deduplication with a heavy-hitter split (operator 6, DataFrame functions only).

Texts are equal when identical after deleting every character of `[\\x20\\x09-\\x0D]`; of equal texts the row with the most code points in the original text, then the smallest doc_id, stays.

1. Every text becomes its SHA-256 digest once; only (doc_id, digest, length) goes on.
2. A frequent-items sketch of the Misra-Gries family (`approx_top_k`, at most `tracked` counters, so a bounded result) names digests that may be frequent.
3. Their true sizes and winners are computed by one map-side-combined aggregation.  Those found more often than rows / tracked are at most `tracked` many; this bounded table is broadcast, and their rows are settled where they are read, without a shuffle.
4. The remaining digests, each found at most rows / tracked times, are counted with map-side combining, and their rows meet the result in an ordinary join on the digest.

Defined cases: null text counts as empty; empty texts are equal to each other and to texts of blanks only; a null doc_id sorts before all others among ties; rows repeated whole are a group in which exactly one row is `kept`; other columns of the input are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foretell.llm.common import BLANKS, few, fresh, materialise


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def digests(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("digest"), F.coalesce(F.char_length("text"), F.lit(0)).alias("length"), F.monotonically_increasing_id().alias("row"))


def exact_duplicates(docs: DataFrame, tracked: int = 1024) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.  `tracked` bounds both the sketch and the broadcast."""
    hashed = materialise(digests(docs))
    sketch = hashed.agg(F.expr(f"approx_top_k(digest, {tracked}, {tracked * 8})").alias("top"), F.count("*").alias("n"))
    candidates = sketch.select(F.explode("top").alias("t"), "n").select(F.col("t.item").alias("digest"), "n")
    best = F.struct((-F.col("length")).alias("longest"), "doc_id", "row")
    winners = (
        hashed.join(F.broadcast(candidates), "digest")
        .groupBy("digest", "n")
        .agg(F.count("*").alias("group_size"), F.min(best).alias("best"))
        .filter(F.col("group_size") > F.greatest(F.lit(1), F.col("n") / tracked))
        .select("digest", "group_size", "best")
    )
    winners = F.broadcast(materialise(few(winners, tracked)))
    heavy = hashed.join(winners, "digest")
    light = hashed.join(winners.select("digest"), "digest", "left_anti")
    light = light.join(light.groupBy("digest").agg(F.count("*").alias("group_size"), F.min(best).alias("best")), "digest")
    return heavy.unionByName(light).select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, tracked: int = 1024) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Decisions are joined back on doc_id and digest; where ids repeat, the longest row of an id and digest stays.
    """
    id_, kept, digest, number = fresh(docs, "kept_id", "kept_digest", "digest", "number")
    stay = exact_duplicates(docs, tracked).filter("kept").select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(kept))
    own = docs.withColumn(digest, F.sha2(normalised(F.col("text")).cast("binary"), 256))
    out = own.join(materialise(stay), F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(digest) == F.col(kept)), "left_semi")
    if docs.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        longest = Window.partitionBy("doc_id", digest).orderBy(F.desc(F.coalesce(F.char_length("text"), F.lit(0))))
        out = out.withColumn(number, F.row_number().over(longest)).filter(F.col(number) == 1)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
