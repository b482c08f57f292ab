"""Expressions on states: arrays of (cell_id, prop)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def single_state(cell: str) -> Column:
    """A certain position: one cell with probability 1."""
    return F.array(F.struct(F.col(cell).alias("cell_id"), F.lit(1.0).alias("prop")))


def zip_states(cells: Column, props: Column) -> Column:
    """Pair up a list of cells and a list of probabilities."""
    zipped = F.arrays_zip(cells.alias("cell_id"), props.alias("prop"))
    return F.transform(
        zipped,
        lambda s: F.struct(s["cell_id"].alias("cell_id"), s["prop"].alias("prop")),
    )


def outer_product(origin: str, destination: str) -> Column:
    """Every (from, to, weight) combination of two states."""
    return F.flatten(
        F.transform(
            F.col(origin),
            lambda a: F.transform(
                F.col(destination),
                lambda b: F.struct(
                    a["cell_id"].alias("from_cell"),
                    b["cell_id"].alias("to_cell"),
                    (a["prop"] * b["prop"]).alias("weight"),
                ),
            ),
        )
    )


def sort_states(states: str) -> Column:
    """Order a state by cell id."""
    return F.array_sort(F.col(states))
