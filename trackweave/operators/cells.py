"""The cell table and the join that places observations in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import store
from .dimensions import Dimension, lookup_join


def normalize_cells(raw: DataFrame) -> DataFrame:
    """Rename the source columns; cell ids are text."""
    return raw.select(
        F.col("locid").cast("string").alias("cell_id"),
        F.col("xtr10").alias("coord_x"),
        F.col("ytr10").alias("coord_y"),
    )


def number_cells(cells: DataFrame) -> DataFrame:
    """Give the cells numbers 1..N in the order of their ids; no id, no number.

    The table is sorted by ranges, numbered within each range and shifted by the rows
    in the ranges before it, so no task sees more than its range; what passes one
    window is a row per range.
    """
    order = [
        F.asc_nulls_last(c) for c in ["cell_id", "coord_x", "coord_y"] if c in cells.columns
    ]
    ranged = store(
        cells.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_place", 33))
    ends = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        ranged.groupBy("_part")
        .agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
        .select("_part", (F.coalesce(F.sum("_n").over(ends), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    )
    number = (F.col("_place") + F.col("_shift")).cast("int")
    return (
        ranged.join(shifts, "_part")
        .withColumn("cell_no", F.when(F.col("cell_id").isNotNull(), number))
        .drop("_part", "_place", "_shift")
    )


def locate_observations(observations: DataFrame, cells: DataFrame | Dimension) -> DataFrame:
    """Attach the cell at exactly the observed coordinates; others vanish."""
    placed = lookup_join(observations, cells, ["coord_x", "coord_y"])
    return placed.select(
        *[c for c in observations.columns if c not in ("coord_x", "coord_y")], "cell_id", "cell_no"
    )
