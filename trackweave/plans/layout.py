"""Observations stored once, so that matrices, slots and starts read them in place."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import session_folder, store
from ..operators.cells import locate_observations
from ..operators.dimensions import Dimension, join_null_safe, lookup_join
from ..operators.observations import dedup_observations, filter_time_slot
from ..operators.pairs import USER_DAY, with_day
from ..operators.sequences import day_shifts
from ..settings import HOT_USER_DAY_ROWS, MAX_BUCKETS, ROWS_PER_BUCKET
from .network import Network

Slot = tuple[int, int, int, int]
COLUMNS = ["user_id", "_day", "ts", "weekday", "hour", "cell_id", "cell_no"]


@dataclass(frozen=True)
class StoredTrajectory:
    """Located rows without copies: (user_id, _day, ts, weekday, hour, cell_id, cell_no).

    ``ordinary`` is a table bucketed by user and day, so that windows over user-days read
    their partitions as they lie. ``crowded`` holds the user-days with too many rows for
    one task, or is None; they are worked off second by second. ``shifts`` are the
    rows of each user before each day, which number the user's sequence.
    """

    network: Network
    ordinary: DataFrame
    crowded: DataFrame | None
    shifts: DataFrame

    def parts(self, order: int = 0) -> tuple[DataFrame, DataFrame | None]:
        """Ordinary and crowded rows, in cells with a ring if rings count."""
        known = self.network.ringed_cells() if order else self.network.cells
        if known.rows == self.network.cells.rows:
            return self.ordinary, self.crowded
        numbers = Dimension(known.df.select("cell_no"), known.rows)
        kept = [
            None if rows is None else lookup_join(rows, numbers, ["cell_no"], "left_semi")
            for rows in (self.ordinary, self.crowded)
        ]
        return kept[0], kept[1]

    def rows(self, order: int = 0, slot: Slot | None = None) -> DataFrame:
        """All rows, with the columns of a trajectory."""
        ordinary, crowded = self.parts(order)
        rows = ordinary if crowded is None else ordinary.unionByName(crowded)
        rows = rows.drop("_day")
        return filter_time_slot(rows, *slot) if slot else rows


def _stored_by_user_day(rows: DataFrame, buckets: int) -> DataFrame:
    """A bucketed table of rows that are partitioned that way already."""
    spark = rows.sparkSession
    name = f"trackweave_{uuid.uuid4().hex}"
    path = os.path.join(session_folder(spark), name)
    writer = rows.write.format("parquet").option("path", path)
    writer.bucketBy(buckets, *USER_DAY).sortBy(*USER_DAY, "ts").saveAsTable(name)
    return spark.table(name)


def store_trajectory(
    observations: DataFrame, network: Network, hot_rows: int | None = HOT_USER_DAY_ROWS
) -> StoredTrajectory:
    """Remove copies from raw observations, locate them and store them by user-day.

    Rows without a user or a time belong to no sequence and are left out. One count of the
    raw user-days gives the number of buckets and the user-days above ``hot_rows``
    rows; their copies collapse before they move.
    """
    timed = with_day(
        observations.filter(F.col("user_id").isNotNull() & F.col("ts").isNotNull())
    )
    sizes = store(timed.groupBy(*USER_DAY).count())
    total = sizes.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    buckets = min(1 + total // ROWS_PER_BUCKET, MAX_BUCKETS)
    buckets = max(buckets, timed.sparkSession.sparkContext.defaultParallelism)

    def placed(rows: DataFrame) -> DataFrame:
        return locate_observations(dedup_observations(rows), network.cells).select(*COLUMNS)

    hot = None
    if hot_rows is not None:
        found = sizes.filter(F.col("count") > hot_rows).select(*USER_DAY)
        n_hot = found.count()
        hot = Dimension(store(found), n_hot) if n_hot else None
    if hot is None:
        cold, crowded = timed, None
    else:
        cold = join_null_safe(timed, hot.joinable(), USER_DAY, "left_anti")
        crowded = store(placed(join_null_safe(timed, hot.joinable(), USER_DAY, "left_semi")))
    located = placed(cold.repartition(buckets, *USER_DAY))
    if not network.cells.fits_broadcast:
        # The lookup moved the rows.
        located = located.repartition(buckets, *USER_DAY)
    ordinary = _stored_by_user_day(located, buckets)
    whole = ordinary if crowded is None else ordinary.unionByName(crowded)
    return StoredTrajectory(network, ordinary, crowded, store(day_shifts(whole)))
