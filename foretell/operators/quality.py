"""Data-quality rules and incremental merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Severities in ascending order.
SEVERITY = ["INFO", "WARNING", "ERROR", "CRITICAL"]


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def required_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """column, present, filled (rows with a value) and gap (share of rows without) of every required column, in one pass; a column that is not there has no value in any row."""
    have = [c for c in required if c in df.columns]
    counts = df.agg(F.count("*").alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(f"_f{k}") for k, c in enumerate(have)])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(c in have).alias("present"), (F.col(f"_f{have.index(c)}") if c in have else F.lit(0).cast("long")).alias("filled")) for c in required]
    return counts.select("_rows", F.inline(F.array(*rows))).select("column", "present", "filled", (1 - F.try_divide("filled", "_rows")).alias("gap"))


def out_of_range(df: DataFrame, column: str, key: str, low: float = 0.0, high: float = 1.0, sample: int = 10) -> DataFrame:
    """How many values lie outside a range, their extremes and the smallest ids; ids are found with a bounded top-k."""
    bad = df.filter((F.col(column) < low) | (F.col(column) > high))
    few = bad.select(key).orderBy(key).limit(sample).agg(F.sort_array(F.collect_list(key)).alias("sample_ids"))
    return bad.agg(F.count("*").alias("n"), F.min(column).alias("least"), F.max(column).alias("most")).crossJoin(few)


def repeated_pairs(df: DataFrame, key: str, a: str, b: str, places: int = 4, least: int = 3) -> DataFrame:
    """Rounded value pairs that at least `least` keys share."""
    first = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(key, F.round(a, places).alias(a), F.round(b, places).alias(b)).distinct()
    return first.groupBy(a, b).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def outside_domain(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(allowed)).groupBy(column).count()


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of values that are there, per column and over all of them."""
    have = {c: F.avg(F.col(c).isNotNull().cast("double")) for c in columns}
    return df.agg(*[x.alias(c) for c, x in have.items()], (sum(have.values()) / len(columns)).alias("overall"))


def covered(df: DataFrame, rows: Column, fields: list[str], least: float = 0.85) -> DataFrame:
    """Of the rows meant: how many, values missing by field, the share of all fields that is there, the threshold, and whether it is missed; fields that df lacks are missing throughout, and without rows nothing is missed."""
    missing = {f: F.count_if(F.col(f).isNull()) if f in df.columns else F.count("*") for f in fields}
    m = df.filter(rows).agg(F.count("*").alias("n"), *[x.alias(f"missing_{f}") for f, x in missing.items()])
    all_missing = sum((F.col(f"missing_{f}") for f in fields), F.lit(0))
    m = m.withColumn("coverage", F.coalesce(1 - F.try_divide(all_missing, F.col("n") * len(fields)), F.lit(1.0)))
    return m.withColumn("threshold", F.lit(least)).withColumn("too_low", F.col("coverage") < least)


def overlap(df: DataFrame, keys: list[str], venue: str, prediction: str, id_: str, venues: tuple[str, str] = ("polymarket", "kalshi")) -> DataFrame:
    """Elections (keys) by the venues that have them: keys, side (both, or the one venue's name, or other), and per venue the number of markets, their mean prediction and smallest id."""
    of = lambda v, x: F.when(F.col(venue) == v, x)
    each = [f(of(v, F.col(c))).alias(f"{name}_{v}") for v in venues for name, f, c in (("n", F.count, id_), ("prediction", F.avg, prediction), ("first", F.min, id_))]
    out = df.groupBy(*keys).agg(*each, F.count("*").alias("_all"))
    a, b = (F.col(f"n_{v}") > 0 for v in venues)
    return out.withColumn("side", F.when(a & b, "both").when(a & (F.col(f"n_{venues[0]}") == F.col("_all")), venues[0]).when(b & (F.col(f"n_{venues[1]}") == F.col("_all")), venues[1]).otherwise("other")).drop("_all")


def skew(df: DataFrame, column: str, most: float = 0.5) -> DataFrame:
    """Values that hold more than `most` of the rows."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("total")).filter(F.col("share") > most).select(column, "n", "share")


def report(issues: DataFrame) -> DataFrame:
    """Issues by level and the worst level of all (rule, level, n)."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("level"))
    return issues.filter(F.col("n") > 0).agg(*[F.count_if(F.col("level") == s).alias(s.lower()) for s in SEVERITY], F.element_at(F.array(*map(F.lit, SEVERITY)), F.max(rank).cast("int")).alias("status"))


def only_new(new: DataFrame, master: DataFrame, ids: list[str]) -> DataFrame:
    """Rows of new whose ids are nowhere in master; a null id does not match."""
    out = new
    for c in ids:
        out = out.join(master.select(c).filter(F.col(c).isNotNull()).distinct(), c, "left_anti")
    return out.select(new.columns)


def merge(master: DataFrame, new: DataFrame, ids: list[str], renames: dict[str, str] | None = None) -> DataFrame:
    """master with the rows that are only in new; columns of either side are kept and filled with null."""
    return master.unionByName(only_new(new, master, ids).withColumnsRenamed(renames or {}), allowMissingColumns=True)


def yes_no(outcome: Column) -> Column:
    """Yes and No in one case; other outcomes as they are."""
    low = F.lower(outcome)
    return F.when(low == "yes", "Yes").when(low == "no", "No").otherwise(outcome)


def merge_aligned(master: DataFrame, new: DataFrame, ids: list[str], renames: dict[str, str], outcome: str) -> DataFrame:
    """master with the rows that are only in new, in master's columns and types: columns of new are renamed, cast to master's type (what does not fit is null), those that master lacks are dropped, those that new lacks are null, and outcomes have one case throughout."""
    added = only_new(new.withColumnsRenamed(renames), master, ids)
    fitted = added.select(*[(F.col(f"`{f.name}`").cast("string").try_cast(f.dataType) if f.name in added.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in master.schema])
    return master.unionByName(fitted).withColumn(outcome, yes_no(F.col(outcome)))


def prefer(primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """All of primary, and fallback's rows for keys that primary does not have."""
    return primary.unionByName(fallback.join(primary.select(key).distinct(), key, "left_anti").select(primary.columns))


def latest_two(df: DataFrame, key: str, ts: str, value: str, tie: list[str]) -> DataFrame:
    """Latest value and its change from the observation before (by order, not by time)."""
    w = Window.partitionBy(key).orderBy(F.desc(ts), *[F.desc(t) for t in tie])
    two = df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= 2)
    at = lambda n: F.max(F.when(F.col("_n") == n, F.col(value)))
    return two.groupBy(key).agg(at(1).alias("latest"), (at(1) - at(2)).alias("last_change"))


def changes(today: DataFrame, before: DataFrame, key: str, value: str) -> DataFrame:
    """added, removed or changed keys with both values."""
    a, b = before.select(key, F.col(value).alias("old")), today.select(key, F.col(value).alias("new"))
    j = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), key, "full_outer")
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return j.withColumn("change", kind).filter(F.col("change").isNotNull()).select(key, "change", "old", "new")


def vote(df: DataFrame, stages: list[str]) -> DataFrame:
    """df with `voted`, the most frequent valid stage value (first seen on ties), and `votes`."""
    valid = F.array_compact(F.array(*stages))
    tally = F.transform(F.array_distinct(valid), lambda v: F.struct(F.size(F.filter(valid, lambda x: x == v)).alias("n"), (-F.array_position(valid, v)).alias("first"), v.alias("v")))
    best = F.array_max(tally)
    return df.withColumn("voted", best.v).withColumn("votes", F.coalesce(best.n, F.lit(0)))


def stale(df: DataFrame, now: int, close: str = "close_ts", status: str = "status", result: str = "result") -> DataFrame:
    """Markets past their close that are still open without a result."""
    return df.filter((F.col(close) > 0) & (F.col(close) < now) & (F.col(status) == "open") & F.col(result).isNull())


def override(df: DataFrame, value: str, hint: str, confidence: str) -> DataFrame:
    """df with `value` replaced by a hint of high confidence."""
    return df.withColumn(value, F.when((F.col(confidence) == "high") & F.col(hint).isNotNull(), F.col(hint)).otherwise(F.col(value)))


def daily_summary(df: DataFrame, ts: str, key: str, since: int) -> DataFrame:
    """Rows since a time by platform: how many, of which categories (sorted set), and the smallest ids."""
    new = df.filter(F.col(ts) >= since)
    return new.groupBy("platform").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("category")).alias("categories"), F.min(key).alias("first_id"))


def resolution_rate(df: DataFrame, closed: Column, outcome: str, least: float = 0.7) -> DataFrame:
    """Closed markets, how many lack an outcome, the share that has one, and whether that is too low."""
    m = df.filter(closed).agg(F.count("*").alias("closed"), F.count_if(F.col(outcome).isNull()).alias("missing"))
    m = m.withColumn("rate", 1 - F.try_divide("missing", "closed"))
    return m.withColumn("too_low", F.coalesce(F.col("rate") < least, F.lit(False)))


def spikes(df: DataFrame, day: Column, most: int = 500) -> DataFrame:
    """Days with more than `most` new rows."""
    return df.groupBy(day.alias("day")).agg(F.count("*").alias("n")).filter(F.col("n") > most)


def failure_rate(df: DataFrame, failed: Column, most: float = 0.1) -> DataFrame:
    """Calls, failures, their share, and whether that is too high; none without calls."""
    m = df.agg(F.count("*").alias("calls"), F.count_if(failed).alias("errors")).filter("calls > 0")
    return m.withColumn("rate", F.col("errors") / F.col("calls")).withColumn("too_high", F.col("rate") > most)


def metadata_gap(df: DataFrame, fields: list[str], most: float = 0.15) -> DataFrame:
    """Rows, the mean share of missing values over fields, and whether that is too high; none without rows."""
    missing = [F.avg(F.col(f).isNull().cast("double")) for f in fields]
    m = df.agg(F.count("*").alias("n"), (sum(missing) / len(fields)).alias("gap")).filter("n > 0")
    return m.withColumn("too_high", F.col("gap") > most)
