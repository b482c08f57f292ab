"""Ring neighbourhoods as probability distributions over cells.

The long form, one row per (cell, neighbour), feeds the matrix plans. The wide
form, one row per cell with lists, is what trajectories carry as states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import zip_states
from ..settings import RING_WEIGHTS
from .dimensions import Dimension, lookup_join, measure

ORDERS = (1, 2, 3)


def _mass(order: int) -> float:
    """Probability mass used when rings up to ``order`` (0 to 3) count."""
    if order not in (0, *ORDERS):
        raise ValueError(f"ring order {order} is not in 0 to {ORDERS[-1]}")
    return sum(RING_WEIGHTS[: order + 1])


def records_from_adjacency(adjacency: DataFrame) -> DataFrame:
    """Records (ring_order, cell_id, n, members) from one row per neighbour.

    Every cell has a record of every order; an empty ring has no members.
    """
    listed = adjacency.filter(F.col("ring_order") >= 1)
    return complete_records(
        listed.groupBy("ring_order", "cell_id").agg(
            F.count("*").cast("int").alias("n"),
            F.sort_array(F.collect_list("neighbor_id")).alias("members"),
        ),
        adjacency.select("cell_id"),
    )


def complete_records(records: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """The records and, for orders that a cell lacks, empty ones.

    The cells are those of the records and of ``cells``. Placeholders join the records
    in one aggregate per cell and order.
    """
    known = records.select("cell_id") if cells is None else records.select("cell_id").union(cells.select("cell_id"))
    empty = known.distinct().select(
        F.explode(F.array(*[F.lit(k) for k in ORDERS])).alias("ring_order"),
        "cell_id",
        F.lit(0).alias("n"),
        F.array().cast("array<string>").alias("members"),
    )
    given = records.select("ring_order", "cell_id", "n", "members")
    return (
        given.unionByName(empty)
        .groupBy("ring_order", "cell_id")
        .agg(F.max(F.struct("n", "members")).alias("_record"))
        .select("ring_order", "cell_id", "_record.n", "_record.members")
    )


def _aligned(records: DataFrame, column: str) -> DataFrame:
    """``column`` of the three orders of each cell, side by side."""
    wide = [F.max(F.when(F.col("ring_order") == k, F.col(column))).alias(f"{column}_{k}") for k in ORDERS]
    return complete_records(records).groupBy("cell_id").agg(*wide)


def align_ring_counts(records: DataFrame) -> DataFrame:
    """Member counts n_1, n_2, n_3 of each cell; a ring without a record is empty."""
    return _aligned(records, "n")


def ring_probability(counts: DataFrame) -> DataFrame:
    """Own mass and the mass of one neighbour in each ring; null for an empty ring."""
    shares = [
        F.try_divide(F.lit(RING_WEIGHTS[k]), F.col(f"n_{k}")).alias(f"prop_{k}") for k in ORDERS
    ]
    return counts.select("*", F.lit(RING_WEIGHTS[0]).alias("self_prop"), *shares)


def align_ring_members(records: DataFrame) -> DataFrame:
    """Member lists members_1, members_2, members_3 of each cell; empty rings are empty lists."""
    return _aligned(records, "members")


def join_ring_parts(counts: DataFrame, members: DataFrame) -> DataFrame:
    """Counts, masses and member lists of each cell."""
    return counts.join(members, "cell_id")


def ring_repeat_weights(parts: DataFrame) -> DataFrame:
    """Repeat the mass of each ring so that it lines up with its members."""
    repeated = [
        F.array_repeat(F.col(f"prop_{k}"), F.col(f"n_{k}")).alias(f"props_{k}") for k in ORDERS
    ]
    return parts.select("*", *repeated)


def ring_states(parts: DataFrame, order: int) -> DataFrame:
    """States (cell_id, states) from the parts with repeated weights."""
    used = ORDERS[:order]
    cells = F.concat(F.array("cell_id"), *[F.col(f"members_{k}") for k in used])
    props = F.concat(F.array("self_prop"), *[F.col(f"props_{k}") for k in used])
    scaled = F.transform(props, lambda p: p / F.lit(_mass(order)))
    return parts.select("cell_id", zip_states(cells, scaled).alias("states"))


def ring_distribution(adjacency: DataFrame, order: int) -> DataFrame:
    """Long form (cell_id, neighbor_id, prop) over rings 0 to ``order``.

    The share of an empty ring is not handed to the other rings.
    """
    ring = Window.partitionBy("cell_id", "ring_order")
    weights = F.array(*[F.lit(w) for w in RING_WEIGHTS])
    return adjacency.filter(F.col("ring_order") <= order).select(
        "cell_id",
        "neighbor_id",
        (
            F.element_at(weights, F.col("ring_order") + 1)
            / F.count("*").over(ring)
            / F.lit(_mass(order))
        ).alias("prop"),
    )


def states_from_distribution(distribution: DataFrame) -> DataFrame:
    """Pack the long form into one state per cell."""
    entry = F.struct(F.col("neighbor_id").alias("cell_id"), "prop")
    return distribution.groupBy("cell_id").agg(F.array_sort(F.collect_list(entry)).alias("states"))


def number_distribution(distribution: DataFrame, cells: DataFrame | Dimension) -> DataFrame:
    """The long form on cell numbers (cell_no, link_no, prop), known cells only."""
    numbers = measure(cells)
    ids = Dimension(numbers.df.select("cell_id", "cell_no"), numbers.rows)
    links = Dimension(
        numbers.df.select(F.col("cell_id").alias("neighbor_id"), F.col("cell_no").alias("link_no")),
        numbers.rows,
    )
    placed = lookup_join(distribution, ids, ["cell_id"])
    return lookup_join(placed, links, ["neighbor_id"]).select("cell_no", "link_no", "prop")
