"""Library inputs derived from the ``events`` table.

Every user lives in a district: a block of 10 x 10 antennas. Fifty users share a
district, so the network grows with the users. An event is
seen by antenna ``k`` (0..99) of the user's district. Antennas 96..99 are not in
the cell table: their observations are off-network, and rings point at them.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave import Network
from trackweave.lineage import store
from trackweave.operators import normalize_observations
from trackweave.plans import StoredTrajectory, store_trajectory
from trackweave.settings import HOT_USER_DAY_ROWS

USERS_PER_DISTRICT = 50

_antennas: dict[tuple[str, str], DataFrame] = {}
_networks: dict[tuple[str, str], Network] = {}
_trajectories: dict[tuple, StoredTrajectory] = {}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the antenna ``k`` and the ``district``."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(os.path.join(sf_dir, "events.parquet")).select(
        "event_id",
        "ts",
        "user_id",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.floor(F.col("user_id") / USERS_PER_DISTRICT).cast("int").alias("district"),
    )


def _x() -> Column:
    return (10 * (F.col("k") % 10) + 5 + 100 * F.col("district")).cast("double")


def _y() -> Column:
    return (10 * F.floor(F.col("k") / 10) + 5).cast("double")


def raw_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the columns of an observation file; some hours are missing."""
    return events(spark, sf_dir).select(
        F.col("user_id").alias("uid"),
        F.col("ts").cast("timestamp").alias("usage_dttm"),
        F.when(F.col("event_id") % 97 != 0, F.hour("ts")).alias("tidenhnum"),
        _x().alias("xtr10"),
        _y().alias("ytr10"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_observations(raw_observations(spark, sf_dir))


def repeated_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observations and, for some, a second one at the same instant nearby."""
    again = events(spark, sf_dir).filter("event_id % 50 = 0").select(
        F.col("user_id").alias("uid"),
        F.col("ts").cast("timestamp").alias("usage_dttm"),
        F.when(F.col("event_id") % 97 != 0, F.hour("ts")).alias("tidenhnum"),
        F.when(F.col("k") % 10 == 9, _x() - 90).otherwise(_x() + 10).alias("xtr10"),
        _y().alias("ytr10"),
    )
    return normalize_observations(raw_observations(spark, sf_dir).unionByName(again))


def stored_antennas(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _antennas:
        _antennas[key] = store(antennas(spark, sf_dir))
    return _antennas[key]


def antennas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every antenna that saw an event, on a grid."""
    return (
        events(spark, sf_dir)
        .select("k", "district")
        .distinct()
        .select(
            "k",
            (1000 + 100 * F.col("district") + F.col("k")).cast("string").alias("cell_id"),
            _x().alias("coord_x"),
            _y().alias("coord_y"),
            (F.col("k") % 10 + 10 * F.col("district")).cast("int").alias("column"),
            F.floor(F.col("k") / 10).cast("int").alias("line"),
        )
    )


def raw_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known antennas with the columns of a cell file."""
    return antennas(spark, sf_dir).filter("k < 96").select(
        F.col("cell_id").alias("locid"),
        F.col("coord_x").alias("xtr10"),
        F.col("coord_y").alias("ytr10"),
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = stored_antennas(spark, sf_dir).filter("k < 96")
    return known.select("cell_id", "coord_x", "coord_y")


def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Antennas up to three grid steps apart; the distance is the ring order."""
    near = F.sequence(F.lit(-3), F.lit(3))
    here = stored_antennas(spark, sf_dir)
    offsets = here.select("cell_id", "column", "line", F.explode(near).alias("dx")).select(
        "cell_id",
        (F.col("column") + F.col("dx")).alias("column"),
        "line",
        "dx",
        F.explode(near).alias("dy"),
    )
    there = here.select(F.col("cell_id").alias("neighbor_id"), "column", "line")
    return (
        offsets.withColumn("line", F.col("line") + F.col("dy"))
        .join(there, ["column", "line"])
        .select(
            "cell_id",
            "neighbor_id",
            F.greatest(F.abs("dx"), F.abs("dy")).alias("ring_order"),
        )
    )


def network(spark: SparkSession, sf_dir: str) -> Network:
    """The network of a table folder, computed once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _networks:
        _networks[key] = Network(cells(spark, sf_dir), adjacency(spark, sf_dir))
    return _networks[key]


def stored_trajectory(
    spark: SparkSession, sf_dir: str, hot_rows: int | None = HOT_USER_DAY_ROWS
) -> StoredTrajectory:
    """The observations by user-day, stored once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, hot_rows)
    if key not in _trajectories:
        _trajectories[key] = store_trajectory(
            observations(spark, sf_dir), network(spark, sf_dir), hot_rows
        )
    return _trajectories[key]
