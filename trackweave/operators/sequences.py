"""Observed sequences: every position of a user with its number, whatever the date.

A user may own a large share of all rows, so no step gathers a user in one task:
numbers are shifts per user-day plus places within it, and the previous state is looked
up within blocks of steps and carried over their borders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import epoch_second
from ..settings import STEPS_PER_BLOCK
from .dimensions import by_shuffle, join_null_safe
from .pairs import USER_DAY, USER_SECOND, with_day


def _shifts(groups: DataFrame, keys: list[str], within: list[str]) -> DataFrame:
    """Rows of ``groups`` (keys, _n) before each one, by the last key."""
    earlier = Window.partitionBy(*within).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    return groups.select(*keys, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))


def day_shifts(trajectory: DataFrame) -> DataFrame:
    """(user_id, _day, _shift): the user's rows on earlier dates. A row per user-day."""
    days = with_day(trajectory).groupBy(*USER_DAY).agg(F.count("*").alias("_n"))
    return _shifts(days, USER_DAY, ["user_id"])


def number_steps(
    trajectory: DataFrame, shifts: DataFrame, state: str = "cell_no", crowded: bool = False
) -> DataFrame:
    """Add ``i``: the number of the row in the user's sequence, from 1, by time.

    ``shifts`` are the ``day_shifts`` of the whole trajectory. ``crowded`` is for the
    rows of hot user-days: they are numbered second by second.
    """
    rows = with_day(trajectory)
    if crowded:
        rows = rows.withColumn("_second", epoch_second("ts"))
        seconds = rows.groupBy(*USER_SECOND).agg(F.count("*").alias("_n"))
        places = _shifts(seconds, USER_SECOND, USER_DAY).withColumnRenamed("_shift", "_begin")
        rows = join_null_safe(rows, places, USER_SECOND, "inner")
        place = F.col("_begin") + F.row_number().over(Window.partitionBy(*USER_SECOND).orderBy("ts", state))
    else:
        place = F.row_number().over(Window.partitionBy(*USER_DAY).orderBy("ts", state))
    numbered = rows.withColumn("_place", place)
    # A row per user-day is too much to broadcast, even where its file is small.
    return (
        join_null_safe(numbered, by_shuffle(shifts), USER_DAY, "inner")
        .withColumn("i", (F.col("_shift") + F.col("_place")).cast("int"))
        .drop("_place", "_shift", "_second", "_begin", "_day")
    )


def lag_state_by_step(
    walks: DataFrame, state: str = "cell_no", block_steps: int = STEPS_PER_BLOCK
) -> DataFrame:
    """Add ``prev_<state>``: the state of the user's row before, by step.

    Rows look back within a block of steps; the first of a block takes the last state
    of the user's block before, so one task meets a block, and then a row per block.
    """
    keys = ["user_id", "_block"]
    rows = walks.withColumn("_block", F.floor((F.col("i") - 1) / block_steps))
    in_block = Window.partitionBy(*keys).orderBy("i")
    last = rows.groupBy(*keys).agg(F.max_by(state, "i").alias("_last"))
    carried = last.select(
        *keys, F.lag("_last").over(Window.partitionBy("user_id").orderBy("_block")).alias("_carried")
    )
    numbered = rows.withColumn("_row", F.row_number().over(in_block)).withColumn(
        "_within", F.lag(state).over(in_block)
    )
    previous = F.when(F.col("_row") == 1, F.col("_carried")).otherwise(F.col("_within"))
    return (
        join_null_safe(numbered, by_shuffle(carried), keys, "inner")
        .withColumn(f"prev_{state}", previous)
        .drop("_row", "_within", "_carried", "_block")
    )
