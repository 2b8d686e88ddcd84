"""Places: region boxes, roll-up by coordinates, cleaning of conflict events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Region, least and largest latitude, least and largest longitude, in the order of trial.
BOXES = [("europe", 35, 72, -25, 40), ("north_america", 15, 72, -170, -50), ("south_america", -56, 15, -82, -34), ("middle_east", 12, 42, 25, 63), ("africa", -35, 37, -18, 52), ("oceania", -50, 0, 110, 180)]


def region(lat: Column, lng: Column) -> Column:
    boxes = [F.when(lat.between(a, b) & lng.between(c, d), name) for name, a, b, c, d in BOXES]
    return F.coalesce(*boxes, F.when((lat >= -10) & ((lng > 40) | (lng < -130)), "asia"), F.lit("unknown"))


def by_coordinates(df: DataFrame, lat: str, lng: str, volume: str, tie: str, any_flags: list[str], places: int = 2) -> DataFrame:
    """One row per rounded place: the member with the largest volume, the sum of volumes, the count, and whether any member has each flag."""
    place = [F.round(lat, places).alias("lat"), F.round(lng, places).alias("lng")]
    return df.groupBy(*place).agg(F.max_by(tie, F.struct(volume, -F.col(tie))).alias("top"), F.sum(volume).alias("total_volume"), F.count("*").alias("n"), *[F.bool_or(f).alias(f) for f in any_flags])


def clean_events(df: DataFrame, notes: str, longest: int = 200) -> DataFrame:
    """Events away from (0, 0), notes cut to `longest` characters, newest first."""
    return df.filter(~((F.col("lat") == 0) & (F.col("lng") == 0))).withColumn(notes, F.substring(notes, 1, longest)).orderBy(F.desc("date"))
