"""Segmented scan: what a window over a whole key computes, in tasks of equal size whatever the keys hold.

Rows are range-partitioned by (keys, order) and written with the number of their partition, so a key that holds any share of the rows lies in many consecutive partitions.  Each (key, partition) is scanned by itself; its totals and last values form a small table, over which the same scan gives what earlier partitions hand on.  Only keys in more than one partition have a row there, at most two for each partition, so it is broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foretell.sources.shared import written


def running(rows: DataFrame, keys: list[str], order: list[str], totals: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, wholes: dict[str, Column] | None = None, pieces: int | None = None) -> DataFrame:
    """rows with, by key and up to each row in `order`: sums (totals), last values that are not null (lasts), and, whatever the row, the sum over its key (wholes).  Keys may be null; rows that order does not tell apart share nothing, so it should end in what does.

    pieces: partitions to deal to (as many as the session shuffles to by default).
    """
    totals, lasts, wholes = totals or {}, lasts or {}, wholes or {}
    pieces = pieces or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inputs = {f"_x_{n}": c for n, c in {**totals, **lasts, **wholes}.items()}
    dealt = written(rows.withColumns(inputs).repartitionByRange(pieces, *keys, *order).withColumn("_part", F.spark_partition_id()))
    own = [*keys, "_part"]
    line = Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = {n: F.coalesce(F.sum(f"_x_{n}").over(line), F.lit(0)) for n in totals} | {n: F.last(f"_x_{n}", ignorenulls=True).over(line) for n in lasts}
    local |= {n: F.coalesce(F.sum(f"_x_{n}").over(Window.partitionBy(*own)), F.lit(0)) for n in wholes}
    scanned = dealt.withColumns(local)

    at_end = [F.sum(f"_x_{n}").alias(f"_c_{n}") for n in (*totals, *wholes)] + [F.max_by(f"_x_{n}", F.when(F.col(f"_x_{n}").isNotNull(), F.struct(*order))).alias(f"_c_{n}") for n in lasts]
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.partitionBy(*keys)
    carry = dealt.groupBy(*own).agg(*at_end).withColumn("_parts", F.count("*").over(all_of)).filter("_parts > 1")
    handed = [F.sum(f"_c_{n}").over(before).alias(f"_h_{n}") for n in totals] + [F.last(f"_c_{n}", ignorenulls=True).over(before).alias(f"_h_{n}") for n in lasts]
    handed += [(F.sum(f"_c_{n}").over(all_of) - F.coalesce(f"_c_{n}", F.lit(0))).alias(f"_h_{n}") for n in wholes]
    carry = carry.select(*[F.col(k).alias(f"_scan_key_{i}") for i, k in enumerate(keys)], F.col("_part").alias("_scan_part"), *handed)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_scan_key_{i}")) for i, k in enumerate(keys)], F.col("_part") == F.col("_scan_part"))
    both = scanned.join(F.broadcast(carry), same, "left")
    out = {n: F.coalesce(n, f"_h_{n}") if n in lasts else F.col(n) + F.coalesce(f"_h_{n}", F.lit(0)) for n in (*totals, *lasts, *wholes)}
    return both.withColumns(out).select(*rows.columns, *out)
