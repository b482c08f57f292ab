"""Distributions over cells and their evolution under a matrix.

A distribution is rows (cell_no, p); a cell without a row has probability 0.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import store
from ..settings import (
    BROADCAST_ROWS,
    PACKED_CELLS,
    PROPAGATE_STEPS_PER_CHECKPOINT,
    ROWS_PER_LOOP_TASK,
)
from .dimensions import Dimension, lookup_join, measure
from .packed import PackedEvolution


def simplify_vector_ids(vector: DataFrame, cells: DataFrame | Dimension) -> DataFrame:
    """Attach the cell number to rows with a cell id; unknown cells vanish."""
    return lookup_join(vector, cells, ["cell_id"])


def initial_distribution(starts: DataFrame, links: DataFrame | Dimension | None = None) -> DataFrame:
    """Mean starting state over users, from (user_id, cell_no).

    Starts are counted per cell and then spread over the rings. Users none of
    whose possible cells is known do not count; the result is not rescaled when
    only some of them are unknown. The number of users is a one-row aggregate of
    the counts, which each cell's share then refers to.
    """
    counts = store(starts.groupBy("cell_no").agg(F.count("*").alias("_users")))
    if links is None:
        everyone = counts.agg(F.sum("_users")).scalar()
        return counts.select("cell_no", (F.col("_users") / everyone).alias("p"))
    links = measure(links)
    linked = Dimension(links.df.select("cell_no").distinct(), links.rows)
    everyone = lookup_join(counts, linked, ["cell_no"], "left_semi").agg(F.sum("_users")).scalar()
    return (
        lookup_join(counts, links, ["cell_no"])
        .groupBy(F.col("link_no").alias("cell_no"))
        .agg(F.sum(F.col("_users") * F.col("prop")).alias("_mass"))
        .select("cell_no", (F.col("_mass") / everyone).alias("p"))
    )


def vector_collect(vector: DataFrame) -> DataFrame:
    """Pack a distribution into one row of two parallel lists, ordered by cell."""
    packed = vector.agg(F.array_sort(F.collect_list(F.struct("cell_no", "p"))).alias("_v"))
    return packed.select(F.col("_v.cell_no").alias("cells"), F.col("_v.p").alias("props"))


def to_vector(packed: DataFrame) -> DataFrame:
    """Unpack two parallel lists into rows (cell_no, p)."""
    zipped = F.arrays_zip(F.col("cells").alias("cell_no"), F.col("props").alias("p"))
    return packed.select(F.inline(zipped)).toDF("cell_no", "p")


def _shuffled_step(frame: DataFrame, moves: DataFrame, moved: str, carried: list[str]) -> DataFrame:
    """One step with the vector and the matrix partitioned by origin."""
    return (
        moves.join(frame.hint("shuffle_hash"), "from_no")
        .groupBy(F.col("to_no").alias("from_no"))
        .agg(*[F.expr(text) for text in (*carried, moved)])
    )


def _broadcast_step(frame: DataFrame, moves: DataFrame, moved: str, carried: list[str]) -> DataFrame:
    """One step with the matrix partitioned by destination: the vector comes to the
    rows, and sums stay within their partitions."""
    return (
        moves.join(F.broadcast(frame), "from_no")
        .groupBy("to_no")
        .agg(*[F.expr(text) for text in (*carried, moved)])
        .withColumnRenamed("to_no", "from_no")
    )


def _prepared(start: DataFrame, matrix: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stored start and matrix, and all their cells (cell_no)."""
    start = store(start.select("cell_no", F.col("p").cast("double")))
    matrix = store(matrix.select("from_no", "to_no", "prob"))
    known = start.select("cell_no").union(matrix.select("from_no")).union(matrix.select("to_no"))
    return start, matrix, store(known.distinct())


def _first(start: DataFrame, known: DataFrame) -> DataFrame:
    """The stored first frame (from_no, peak, p_0) of all cells."""
    p = F.coalesce("p", F.lit(0.0))
    return store(
        known.join(start, "cell_no", "left").select(
            F.col("cell_no").alias("from_no"), p.alias("peak"), p.alias("p_0")
        )
    )


class _Evolution:
    """A distribution under a matrix, in blocks of steps.

    ``moves`` are the entries of the matrix and a row from every cell to itself, which
    carries the columns of earlier steps along, so that nothing is read twice. A
    vector of up to ``broadcast_rows`` cells is broadcast at every step and the matrix
    stays where it is; a longer one is shuffled to its origins. A block ends in a
    stored table of (from_no, peak, p_0, p_1, ...): columns of one row per cell, from
    which changes and the greatest probability of a cell are taken on the way.
    """

    def __init__(
        self, start: DataFrame, matrix: DataFrame, broadcast_rows: int, known: DataFrame | None = None
    ) -> None:
        if known is None:
            start, matrix, known = _prepared(start, matrix)
        cells = known.count()
        matrix = matrix.withColumn("stays", F.lit(False))
        self.step = _broadcast_step if cells <= broadcast_rows else _shuffled_step
        stay = known.select(
            F.col("cell_no").alias("from_no"),
            F.col("cell_no").alias("to_no"),
            F.lit(0.0).alias("prob"),
            F.lit(True).alias("stays"),
        )
        moves = matrix.unionByName(stay)
        if cells <= broadcast_rows:
            width = 1 + (matrix.count() + cells) // ROWS_PER_LOOP_TASK
            moves = moves.repartition(width, "to_no")
        else:
            moves = moves.repartition("from_no")
        self.moves = moves.persist()
        # Once the cache is filled its partitioning is known, and steps rely on it.
        self.moves.count()
        self.frame = _first(start, known)

    def advance(self, steps: int) -> DataFrame:
        """The stored columns p_0..p_steps; the last is the next block's p_0."""
        frame = self.frame
        for step in range(steps):
            columns = ["peak", *(f"p_{k}" for k in range(step + 1))]
            carried = [f"max(if(stays, {c}, null)) AS {c}" for c in columns]
            frame = self.step(frame, self.moves, f"sum(p_{step} * prob) AS p_{step + 1}", carried)
        peak = F.greatest("peak", *(F.col(f"p_{k}") for k in range(1, steps + 1)))
        block = store(frame.withColumn("peak", peak))
        self.frame = block.select("from_no", "peak", F.col(f"p_{steps}").alias("p_0"))
        return block

    def close(self) -> None:
        self.moves.unpersist()


def _distances(block: DataFrame, steps: int) -> list[float]:
    """The total change at every step of a block, as one row of sums."""
    changes = [F.sum(F.abs(F.col(f"p_{k}") - F.col(f"p_{k - 1}"))) for k in range(1, steps + 1)]
    return [0.0 if d is None else d for d in block.agg(*changes).first()]


def _listed(block: DataFrame, first: int, steps: list[int]) -> DataFrame:
    """Rows (step, cell_no, p, change) of some columns of a block that begins at ``first``."""
    entries = [
        F.struct(
            F.lit(first + k).alias("step"),
            F.col(f"p_{k}").alias("p"),
            (F.abs(F.col(f"p_{k}") - F.col(f"p_{k - 1}")) if k else F.lit(None).cast("double")).alias(
                "change"
            ),
        )
        for k in steps
    ]
    rows = block.select(F.col("from_no").alias("cell_no"), F.inline(F.array(*entries)))
    return rows.select("step", "cell_no", "p", "change")


class _Evolved(NamedTuple):
    """All (step, cell_no, p, change); the last distribution (cell_no, p), zeros included;
    and the cells (cell_no) that are above zero at some step, or those that never are."""

    steps: DataFrame
    last: DataFrame
    visited: DataFrame | None = None
    unvisited: Dimension | None = None


def _evolve(
    start: DataFrame,
    matrix: DataFrame,
    rows: int,
    every: int,
    broadcast_rows: int | None = None,
    tolerance: float | None = None,
) -> _Evolved:
    """A distribution and its next ones, ``rows`` in all.

    With a ``tolerance`` the step whose total change is not above it is the last.
    """
    start, matrix, known = _prepared(start, matrix)
    whole = all(isinstance(table.schema[0].dataType, T.IntegralType) for table in (start, known))
    if broadcast_rows is None and whole and known.count() <= PACKED_CELLS:
        return _evolve_packed(PackedEvolution(start, matrix, known), _first(start, known), rows, tolerance)
    # The vectors of a block are broadcast in one query and held by the driver together.
    limit = BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    evolution = _Evolution(start, matrix, limit // every, known)
    first = evolution.frame
    parts = [_listed(first, 0, [0])]
    done = 0
    while done < rows - 1:
        steps = min(every, rows - 1 - done)
        block = evolution.advance(steps)
        kept = list(range(1, steps + 1))
        if tolerance is not None:
            settled = [k for k, d in zip(kept, _distances(block, steps)) if d <= tolerance]
            if settled:
                kept = kept[: settled[0]]
                peak = F.greatest(*(F.col(f"p_{k}") for k in range(settled[0] + 1)), first["peak"])
                seen = block.drop("peak").join(first.select("from_no", "peak"), "from_no")
                last = F.col(f"p_{kept[-1]}").alias("p_0")
                evolution.frame = store(seen.select("from_no", peak.alias("peak"), last))
                parts.append(_listed(block, done, kept))
                break
        parts.append(_listed(block, done, kept))
        first = evolution.frame
        done += steps
    evolution.close()
    ended = evolution.frame.select(F.col("from_no").alias("cell_no"), "peak", F.col("p_0").alias("p"))
    return _Evolved(
        reduce(DataFrame.unionByName, parts),
        ended.select("cell_no", "p"),
        visited=ended.filter("peak > 0").select("cell_no"),
    )


def _evolve_packed(
    evolution: PackedEvolution, first: DataFrame, rows: int, tolerance: float | None
) -> _Evolved:
    parts, done, settled = [_listed(first, 0, [0])], 0, False
    while done < rows - 1 and not settled:
        block, steps, settled = evolution.advance(rows - 1 - done, tolerance)
        parts.append(_listed(block, done, list(range(1, steps + 1))))
        done += steps
    evolution.close()
    steps = reduce(DataFrame.unionByName, parts)
    last = first.select(F.col("from_no").alias("cell_no"), F.col("p_0").alias("p"))
    if done:
        last = evolution.table({"p": evolution.vector}).withColumnRenamed("from_no", "cell_no")
    never = np.flatnonzero(~evolution.visited)
    absent = evolution.table({}, never).withColumnRenamed("from_no", "cell_no")
    return _Evolved(steps, last, unvisited=Dimension(absent, len(never)))


def propagate_all(
    start: DataFrame,
    matrix: DataFrame,
    rows: int,
    every: int = PROPAGATE_STEPS_PER_CHECKPOINT,
    broadcast_rows: int | None = None,
) -> DataFrame:
    """v, vP, ... as (step, cell_no, p): ``rows`` steps, zeros included.

    A cell without outgoing moves passes nothing on, so its mass leaves.
    ``broadcast_rows`` changes the plan only: with it the matrix is not packed, see
    ``_Evolution``.
    """
    return _evolve(start, matrix, rows, every, broadcast_rows).steps.drop("change")


def propagate(
    start: DataFrame,
    matrix: DataFrame,
    rows: int,
    every: int = PROPAGATE_STEPS_PER_CHECKPOINT,
    broadcast_rows: int | None = None,
) -> DataFrame:
    """v, vP, ... as (step, cell_no, p): ``rows`` steps, without zeros."""
    return propagate_all(start, matrix, rows, every, broadcast_rows).filter(F.col("p") != 0)


def chain_phases(
    start: DataFrame, phases: list[tuple[DataFrame, int]], every: int = PROPAGATE_STEPS_PER_CHECKPOINT
) -> DataFrame:
    """Propagate through several (matrix, rows) phases as (phase, step, cell_no, p).

    The last distribution of a phase is the first of the next.
    """
    parts = []
    for phase, (matrix, rows) in enumerate(phases, start=1):
        evolved = _evolve(start, matrix, rows, every)
        traced = evolved.steps.filter(F.col("p") != 0)
        parts.append(traced.select(F.lit(phase).alias("phase"), "step", "cell_no", "p"))
        start = evolved.last.filter((F.col("p") != 0) & F.lit(rows > 0))
    return reduce(DataFrame.unionByName, parts)


def convergence_trace(
    start: DataFrame,
    matrix: DataFrame,
    rows: int,
    every: int = PROPAGATE_STEPS_PER_CHECKPOINT,
    tolerance: float | None = None,
) -> DataFrame:
    """Every step of every cell that is non-zero at some step, with ``change``.

    ``change`` is how far the probability moved since the step before. With a
    ``tolerance`` the trace ends at the first step whose total change is not above it.
    """
    evolved = _evolve(start, matrix, rows, every, tolerance=tolerance)
    steps = evolved.steps.filter("cell_no is not null")
    if evolved.visited is not None:
        steps = lookup_join(steps, evolved.visited, ["cell_no"], "left_semi")
    elif evolved.unvisited.rows:
        steps = lookup_join(steps, evolved.unvisited, ["cell_no"], "left_anti")
    return steps.select("step", "cell_no", "p", "change")


def convergence_distance(trace: DataFrame) -> DataFrame:
    """Total probability and total change at each step."""
    return trace.groupBy("step").agg(F.sum("p").alias("total"), F.sum("change").alias("distance"))


def mobility_trend(chain: DataFrame, rows: tuple[int, int]) -> DataFrame:
    """Initial, middle and end distribution of a two-phase chain, side by side.

    ``rows`` are the lengths of the two phases.
    """
    phase, step = F.col("phase"), F.col("step")
    slices = {
        "initial": (phase == 1) & (step == 0),
        "middle": (phase == 1) & (step == rows[0] - 1),
        "end": (phase == 2) & (step == rows[1] - 1),
    }
    columns = [
        F.sum(F.when(chosen, F.col("p")).otherwise(0.0)).alias(name)
        for name, chosen in slices.items()
    ]
    return (
        chain.filter(reduce(lambda a, b: a | b, slices.values())).groupBy("cell_no").agg(*columns)
    )
