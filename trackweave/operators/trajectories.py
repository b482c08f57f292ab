"""Trajectories: located observations with a state each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import single_state
from .dimensions import Dimension, lookup_join, measure


def deterministic_states(trajectory: DataFrame) -> DataFrame:
    """Every state is the observed cell with probability 1."""
    return trajectory.withColumn("states", single_state("cell_id"))


def probabilistic_states(trajectory: DataFrame, states: DataFrame | Dimension) -> DataFrame:
    """Every state is the ring distribution of the observed cell.

    Rows in a cell without a ring vanish here, before any pairing.
    """
    return lookup_join(trajectory, states, ["cell_id"])


def pair_states(lagged: DataFrame, states: DataFrame | Dimension) -> DataFrame:
    """Attach ``prev_states`` and ``states`` to rows with ``prev_cell_id``.

    Pairs are formed on ids and get their states afterwards, so that the lists
    need not travel with the rows.
    """
    table = measure(states)
    before = table.df.select(
        F.col("cell_id").alias("prev_cell_id"), F.col("states").alias("prev_states")
    )
    placed = lookup_join(lagged, table, ["cell_id"])
    return lookup_join(placed, Dimension(before, table.rows), ["prev_cell_id"])


def explode_states(trajectory: DataFrame) -> DataFrame:
    """One row per user, instant, cell and probability."""
    return trajectory.select("user_id", "ts", F.inline("states"))


def first_observation(trajectory: DataFrame) -> DataFrame:
    """Each user's first row, with its columns.

    ``min_by`` on the time keeps one candidate per user in every input task.
    """
    rest = [c for c in trajectory.columns if c != "user_id"]
    tie = [c for c in ["ts", "cell_no"] if c in rest]
    row = F.min_by(F.struct(*rest), F.struct(*tie)).alias("_row")
    return trajectory.groupBy("user_id").agg(row).select("user_id", "_row.*")


def start_cells(trajectory: DataFrame) -> DataFrame:
    """(user_id, cell_no) of each user's first row."""
    return trajectory.groupBy("user_id").agg(
        F.min_by("cell_no", F.struct("ts", "cell_no")).alias("cell_no")
    )
