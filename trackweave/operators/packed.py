"""Propagation with the matrix packed into arrays and the vector held by the driver.

A row of the packed matrix is a part of its columns: the destinations, where the
entries of each begin, and the origins and probabilities of the entries, as bytes. A task has all
entries of its destinations, so a step moves nothing but the vector, 8 bytes a cell to
the tasks and 12 back. A matrix of one task makes all its steps there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import store
from ..settings import ENTRIES_PER_PACKED_ROW, ENTRIES_PER_PACKED_TASK, PACKED_VALUES

PACKED = "dest binary, begin binary, origin binary, prob binary"
KINDS = (np.int32, np.int32, np.int32, np.float64)


def _arrays(rows: Iterable[tuple]) -> Iterator[tuple[np.ndarray, ...]]:
    for row in rows:
        yield tuple(np.frombuffer(value, kind) for value, kind in zip(row, KINDS))


def _sums(vector: np.ndarray, begin: np.ndarray, origin: np.ndarray, prob: np.ndarray) -> np.ndarray:
    return np.add.reduceat(vector[origin] * prob, begin)


def pack(matrix: DataFrame, cells: np.ndarray, tasks: int) -> DataFrame:
    """The entries (from_no, to_no, prob) as packed rows; ``cells`` are all cells in order."""
    sent = matrix.sparkSession.sparkContext.broadcast(cells)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, parts = sent.value, []
        for batch in batches:
            ends = [np.searchsorted(cells, batch.column(c).to_numpy(zero_copy_only=False)) for c in (0, 1)]
            parts.append((*(e.astype(np.int32) for e in ends), batch.column(2).to_numpy()))
        if not parts:
            return
        origin, dest, prob = (np.concatenate(column) for column in zip(*parts))
        parts.clear()
        order = np.lexsort((prob, dest.astype(np.int64) * len(cells) + origin))
        origin, dest, prob = origin[order], dest[order], prob[order]
        begin = np.flatnonzero(np.diff(dest, prepend=-1))
        ends = np.append(begin[1:], len(dest))
        first = 0
        while first < len(begin):
            last = int(np.searchsorted(ends, begin[first] + ENTRIES_PER_PACKED_ROW, "right"))
            last = max(last, first + 1)
            part = slice(begin[first], ends[last - 1])
            starts = (begin[first:last] - begin[first]).astype(np.int32)
            arrays = (dest[begin[first:last]], starts, origin[part], prob[part])
            yield pa.RecordBatch.from_arrays(
                [pa.array([a.tobytes()], pa.binary()) for a in arrays], names=["dest", "begin", "origin", "prob"]
            )
            first = last

    entries = matrix.select(
        F.col("from_no").cast("long"), F.col("to_no").cast("long"), F.col("prob").cast("double")
    )
    return entries.repartition(tasks, "to_no").mapInArrow(work, PACKED)


class PackedEvolution:
    """A distribution under a matrix, as ``markov._Evolution``, for whole numbers of cells.

    ``known`` are all cells, ``start`` the first distribution. Repeated cells of the start
    are listed as they come and move together.
    """

    def __init__(self, start: DataFrame, matrix: DataFrame, known: DataFrame) -> None:
        self.spark = start.sparkSession
        self.kind = known.schema["cell_no"].dataType
        named = known.filter("cell_no is not null").select(F.col("cell_no").cast("long"))
        self.cells = np.sort(named.toArrow().column(0).to_numpy())
        p = F.coalesce("p", F.lit(0.0))
        given = (
            start.filter("cell_no is not null")
            .groupBy(F.col("cell_no").cast("long"))
            .agg(F.sum(p).alias("p"), F.max(p).alias("most"))
            .toArrow()
        )
        at = np.searchsorted(self.cells, given.column(0).to_numpy())
        self.vector, self.listed = np.zeros(len(self.cells)), np.zeros(len(self.cells))
        self.vector[at], self.listed[at] = given.column(1).to_numpy(), given.column(2).to_numpy()
        self.visited = _positive(self.listed)
        entries = matrix.filter("from_no is not null and to_no is not null and prob is not null")
        n = entries.count()
        self.tasks = -(-n // ENTRIES_PER_PACKED_TASK)
        self.moves = None
        if n:
            packed = pack(entries, self.cells, self.tasks)
            # Kept as the bytes that tasks read, so that a step neither plans nor converts.
            self.moves = packed.rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)
        # The vectors of a block are held by the driver until they are stored.
        self.steps_at_once = max(PACKED_VALUES // max(len(self.cells), 1), 1)

    def _moved(self, steps: int) -> np.ndarray:
        """The next vectors, one row each: all ``steps`` if one task has the matrix, else one."""
        if self.moves is None:
            return self.vector[None, :] * 0.0
        sent = self.spark.sparkContext.broadcast(self.vector)

        def alone(rows: Iterable[tuple]) -> Iterator[np.ndarray]:
            parts, vector = list(_arrays(rows)), sent.value
            found = np.empty((steps, len(vector)))
            for k in range(steps):
                found[k] = vector * 0.0
                for dest, *entries in parts:
                    found[k, dest] += _sums(vector, *entries)
                vector = found[k]
            yield found

        def together(rows: Iterable[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for dest, *entries in _arrays(rows):
                yield dest, _sums(sent.value, *entries)

        moved = self.moves.mapPartitions(alone if self.tasks == 1 else together).collect()
        sent.destroy()
        if self.tasks == 1:
            return moved[0]
        found = self.vector * 0.0
        for dest, p in moved:
            found[dest] += p
        return found[None, :]

    def advance(self, steps: int, tolerance: float | None = None) -> tuple[DataFrame, int, bool]:
        """The stored columns p_0..p_k of the next k steps, at most ``steps``; k; and whether
        the total change of the last is not above the ``tolerance``."""
        steps, block, settled = min(steps, self.steps_at_once), [self.listed], False
        while len(block) <= steps and not settled:
            for vector in self._moved(steps - len(block) + 1):
                settled = tolerance is not None and float(np.abs(vector - block[-1]).sum()) <= tolerance
                self.visited |= _positive(vector)
                block.append(vector)
                if settled:
                    break
            self.vector = self.listed = block[-1]
        names = [f"p_{k}" for k in range(len(block))]
        return self.table(dict(zip(names, block))), len(block) - 1, settled

    def table(self, columns: dict[str, np.ndarray], wanted: np.ndarray | None = None) -> DataFrame:
        """A stored table (from_no, columns) of the cells, or of the ``wanted`` places of them."""
        if wanted is None:
            wanted = np.arange(len(self.cells))
        rows, names = len(wanted), list(columns)
        sent = self.spark.sparkContext.broadcast((self.cells[wanted], [columns[c][wanted] for c in names]))
        tasks = 1 + rows * (1 + len(names)) // (PACKED_VALUES // 8)

        def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells, values = sent.value
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    for low in range(rows * i // tasks, rows * (i + 1) // tasks, 1 << 16):
                        part = slice(low, min(low + (1 << 16), rows * (i + 1) // tasks))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(cells[part]), *(pa.array(v[part]) for v in values)], names=["from_no", *names]
                        )

        schema = T.StructType(
            [T.StructField("from_no", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in names)]
        )
        made = self.spark.range(0, tasks, 1, tasks).mapInArrow(work, schema)
        stored = store(made.withColumn("from_no", F.col("from_no").cast(self.kind)))
        sent.destroy()
        return stored

    def close(self) -> None:
        if self.moves is not None:
            self.moves.unpersist()


def _positive(vector: np.ndarray) -> np.ndarray:
    """Where Spark finds p > 0, which counts a value that is not a number."""
    return (vector > 0) | np.isnan(vector)
