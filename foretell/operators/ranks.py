"""Ranks and quantiles, of a column or of every group at once, without a window over a whole group.

Equal values are counted first, with map-side combining, and the counts are summed up in value order by the segmented scan (see scan.py), so a group or a value may hold any share of the rows.  Values are ordered as they are, never as doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretell.operators.scan import running
from foretell.sources.shared import written

SHARDS = 16


def global_rank(df: DataFrame, value: str, tie: str, out: str = "rank", descending: bool = False) -> DataFrame:
    """df with the rank (from 1) of each row by value, then tie mod SHARDS, then tie; rows with a null value are left out."""
    key = -F.col(value) if descending else F.col(value)
    rows = df.filter(F.col(value).isNotNull()).withColumn("_all", F.lit(0)).withColumn("_v", key).withColumn("_t", F.pmod(F.col(tie), F.lit(SHARDS))).withColumn("_tie", F.col(tie))
    return running(rows, ["_all"], ["_v", "_t", "_tie"], totals={out: F.lit(1)}).select(*df.columns, out)


def value_counts(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, value, c (rows), upto (rows of the group up to this value) and n (rows of the group); null values are left out.  df is read once."""
    per = written(df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c")))
    return running(per, by, [value], totals={"upto": F.col("c")}, wholes={"n": F.col("c")})


def group_quantiles(df: DataFrame, value: str, shares: dict[str, float], by: list[str]) -> DataFrame:
    """by and, under the names of `shares`, the linear-interpolated quantiles of value in each group; groups without values have no row."""
    held, wanted = value_counts(df, value, by), []
    has = lambda place: (place >= F.col("upto") - F.col("c")) & (place < F.col("upto"))
    any_place = F.lit(False)
    for k, share in enumerate(shares.values()):
        place = (F.col("n") - 1) * F.lit(float(share))
        low, high = F.floor(place), F.ceil(place)
        any_place = any_place | has(low) | has(high)
        v = F.col(value).cast("double")
        wanted += [F.max(F.when(has(low), v)).alias(f"_l{k}"), F.max(F.when(has(high), v)).alias(f"_h{k}"), F.max(place - low).alias(f"_f{k}")]
    found = held.filter(any_place).groupBy(*by).agg(*wanted)
    out = [(F.col(f"_l{k}") + (F.col(f"_h{k}") - F.col(f"_l{k}")) * F.col(f"_f{k}")).alias(name) for k, name in enumerate(shares)]
    return found.select(*by, *out)


def group_medians(df: DataFrame, values: list[str], by: list[str]) -> DataFrame:
    """by and, under the name of each of `values` with `_median`, its median in each group, in one scan for all of them: null where a group has values of others only; a group without any has no row."""
    long = df.select(*by, F.inline(F.array(*[F.struct(F.lit(v).alias("_name"), F.col(v).cast("double").alias("_value")) for v in values])))
    per = group_quantiles(long, "_value", {"_median": 0.5}, [*by, "_name"])
    return per.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == v, F.col("_median"))).alias(f"{v}_median") for v in values])


def quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float]:
    """Exact linear-interpolated quantiles of a column; none without values.  Only these reach the driver."""
    names = {f"q{k}": s for k, s in enumerate(shares)}
    row = group_quantiles(df.select(value).withColumn("_all", F.lit(0)), value, names, ["_all"]).first()
    return [] if row is None else [row[n] for n in names]


def average_rank(df: DataFrame, value: str, out: str = "rank") -> DataFrame:
    """df with the average rank of tied values; null values keep a null rank."""
    return _placed(df, value, [], F.col("upto") - (F.col("c") - 1) / 2, out)


def rank_pct(df: DataFrame, value: str, out: str = "rank_pct", by: str | None = None) -> DataFrame:
    """Average rank over the number of non-null values, in (0, 1]; within a group if `by` is given."""
    return _placed(df, value, [by] if by else [], (F.col("upto") - (F.col("c") - 1) / 2) / F.col("n"), out)


def _placed(df: DataFrame, value: str, by: list[str], place: Column, out: str) -> DataFrame:
    keys = by or ["_all"]
    per = value_counts(df if by else df.withColumn("_all", F.lit(0)), value, keys).select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(by)], F.col(value).alias("_v"), place.alias(out))
    same = F.col(value) == F.col("_v")
    for i, k in enumerate(by):
        same = same & F.col(k).eqNullSafe(F.col(f"_g{i}"))
    return df.join(per, same, "left").drop("_v", *[f"_g{i}" for i in range(len(by))])
