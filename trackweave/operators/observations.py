"""Cleaning of position observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import weekday_number

OBSERVATION_COLUMNS = ["user_id", "ts", "weekday", "hour", "coord_x", "coord_y"]


def normalize_observations(raw: DataFrame) -> DataFrame:
    """Rename the source columns and derive the weekday."""
    return raw.select(
        F.col("uid").alias("user_id"),
        F.col("usage_dttm").cast("timestamp").alias("ts"),
        weekday_number("usage_dttm").alias("weekday"),
        F.col("tidenhnum").alias("hour"),
        F.col("xtr10").alias("coord_x"),
        F.col("ytr10").alias("coord_y"),
    )


def dedup_observations(observations: DataFrame) -> DataFrame:
    """Keep one row per user and instant: the smallest coordinates win.

    An aggregate, not a window: copies already collapse before the shuffle, so a
    huge group of copies costs one row per input task. The weekday follows from
    the time and is derived again rather than shuffled.
    """
    # A date that came along groups nothing further, but lets rows stay where
    # they are if they are partitioned by it.
    keys = [c for c in ("user_id", "_day", "ts") if c in observations.columns]
    first = ["coord_x", "coord_y", "hour"]
    rest = [c for c in observations.columns if c not in [*keys, *first, "weekday"]]
    kept = observations.groupBy(*keys).agg(F.min(F.struct(*first, *rest)).alias("_row"))
    return kept.select(*keys, weekday_number("ts").alias("weekday"), "_row.*").select(
        *observations.columns
    )


def sort_observations(observations: DataFrame) -> DataFrame:
    """Order by user and time, for output only."""
    return observations.orderBy("user_id", "ts")


def filter_time_slot(
    rows: DataFrame, day_begin: int, day_end: int, hour_begin: int, hour_end: int
) -> DataFrame:
    """Keep weekdays from begin through end and hours from begin up to end."""
    return rows.filter(
        F.col("weekday").between(day_begin, day_end)
        & (F.col("hour") >= hour_begin)
        & (F.col("hour") < hour_end)
    )


def tag_slots(rows: DataFrame, slots: list[tuple[int, int, int, int]]) -> DataFrame:
    """A row per observation and slot it falls into, with the place of the slot in the
    list as ``slot``. Slots may overlap; rows outside all of them vanish."""
    inside = [
        F.when(
            F.col("weekday").between(day_begin, day_end)
            & (F.col("hour") >= hour_begin)
            & (F.col("hour") < hour_end),
            F.lit(place),
        )
        for place, (day_begin, day_end, hour_begin, hour_end) in enumerate(slots)
    ]
    return rows.withColumn("slot", F.explode(F.array_compact(F.array(*inside))))


def drop_incomplete(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop rows with a null in any of the columns."""
    return rows.na.drop(subset=columns or rows.columns)
