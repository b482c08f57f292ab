"""Pairing of observations: the previous position and the trip destination.

Both work within a user's calendar day. A user-day is small as a rule and one
window handles it. For those that ``hot_user_days`` reports there is a second
form of each operator that splits by second first: a day has at most 86,400
seconds, so what still meets in one task is bounded however many rows the
user-day holds. Both forms give the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import epoch_second
from ..lineage import store
from ..settings import HOT_USER_DAY_ROWS, OD_HORIZON_SECONDS
from .dimensions import Dimension, by_shuffle, join_null_safe, measure

USER_DAY = ["user_id", "_day"]
USER_SECOND = ["user_id", "_day", "_second"]


def with_day(rows: DataFrame) -> DataFrame:
    """Add the date as ``_day``, unless it came along."""
    return rows if "_day" in rows.columns else rows.withColumn("_day", F.to_date("ts"))


def hot_user_days(rows: DataFrame, limit: int = HOT_USER_DAY_ROWS) -> Dimension | None:
    """User-days of more than ``limit`` rows, or None if there are none.

    Meant for the raw observations: it reads two columns, counts before the
    shuffle, and later steps only remove rows, so nothing hot is missed.
    """
    found = measure(
        with_day(rows.select("user_id", "ts"))
        .groupBy(*USER_DAY)
        .count()
        .filter(F.col("count") > limit)
        .select(*USER_DAY)
    )
    return Dimension(store(found.df), found.rows) if found.rows else None


def split_user_days(rows: DataFrame, hot: Dimension) -> tuple[DataFrame, DataFrame]:
    """The rows outside and inside the hot user-days."""
    rows = with_day(rows)
    cold = join_null_safe(rows, hot.joinable(), USER_DAY, "left_anti")
    return cold, join_null_safe(rows, hot.joinable(), USER_DAY, "left_semi")


def _last_by_second(rows: DataFrame, state: str, within: tuple[str, ...] = ()) -> DataFrame:
    last = F.max_by(state, F.struct("ts", state)).alias("_last")
    return rows.groupBy(*USER_SECOND, *within).agg(last)


def lag_state_by_day(
    trajectory: DataFrame,
    state: str = "cell_no",
    unique_times: bool = False,
    within: tuple[str, ...] = (),
) -> DataFrame:
    """Add ``prev_<state>``: the user's previous state on the same date, if any.

    ``unique_times`` promises at most one row per user and instant, so that time
    alone orders them and rows already sorted by it need no second sort. ``within``
    are columns that have to be equal as well, such as a slot.
    """
    order = ["ts"] if unique_times else ["ts", state]
    by_day = Window.partitionBy(*USER_DAY, *within).orderBy(*order)
    lagged = with_day(trajectory).withColumn(f"prev_{state}", F.lag(state).over(by_day))
    return lagged.drop("_day")


def lag_state_by_second(
    trajectory: DataFrame, state: str = "cell_no", within: tuple[str, ...] = ()
) -> DataFrame:
    """The same for hot user-days.

    Rows look back within their second; the first of a second takes the last
    state of the user's previous second that day.
    """
    rows = with_day(trajectory).withColumn("_second", epoch_second("ts"))
    in_second = Window.partitionBy(*USER_SECOND, *within).orderBy("ts", state)
    over_seconds = Window.partitionBy(*USER_DAY, *within).orderBy("_second")
    carried = _last_by_second(rows, state, within).select(
        *USER_SECOND, *within, F.lag("_last").over(over_seconds).alias("_carried")
    )
    numbered = rows.withColumn("_row", F.row_number().over(in_second)).withColumn(
        "_within", F.lag(state).over(in_second)
    )
    previous = F.when(F.col("_row") == 1, F.col("_carried")).otherwise(F.col("_within"))
    return (
        join_null_safe(numbered, by_shuffle(carried), [*USER_SECOND, *within], "inner")
        .withColumn(f"prev_{state}", previous)
        .drop("_row", "_within", "_carried", "_second", "_day")
    )


def od_destination(
    trajectory: DataFrame, state: str = "cell_no", horizon: int = OD_HORIZON_SECONDS
) -> DataFrame:
    """Add ``dest_<state>``: the user's last state that day within the horizon.

    Times are compared in whole seconds. The row itself counts, so a lone row is
    its own destination. The frame is open below: that cannot change its last
    row, and it only ever grows, where a sliding frame is summed up anew per row.
    """
    rows = with_day(trajectory).withColumn("_second", epoch_second("ts"))
    until = Window.partitionBy(*USER_DAY).orderBy("_second")
    until = until.rangeBetween(Window.unboundedPreceding, horizon)
    last = F.max_by(state, F.struct("ts", state)).over(until)
    return rows.withColumn(f"dest_{state}", last).drop("_day", "_second")


def od_destination_by_second(
    trajectory: DataFrame, state: str = "cell_no", horizon: int = OD_HORIZON_SECONDS
) -> DataFrame:
    """The same for hot user-days.

    The destination depends on the second only. The seconds are merged with the
    questions "last state up to second + horizon?", and a running frame answers
    all of them in one pass.
    """
    rows = with_day(trajectory).withColumn("_second", epoch_second("ts"))
    seconds = _last_by_second(rows, state)
    known = seconds.select(
        *USER_DAY, F.col("_second").alias("_at"), "_last", F.lit(0).alias("_ask")
    )
    asked = seconds.select(
        *USER_DAY,
        (F.col("_second") + horizon).alias("_at"),
        F.lit(None).alias("_last"),
        F.lit(1).alias("_ask"),
    )
    so_far = (
        Window.partitionBy(*USER_DAY)
        .orderBy("_at", "_ask")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    answers = (
        known.unionByName(asked)
        .withColumn(f"dest_{state}", F.last("_last", ignorenulls=True).over(so_far))
        .filter("_ask = 1")
        .select(*USER_DAY, (F.col("_at") - horizon).alias("_second"), f"dest_{state}")
    )
    return join_null_safe(rows, by_shuffle(answers), USER_SECOND, "inner").drop("_day", "_second")
