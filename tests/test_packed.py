"""Propagation with a packed matrix, against numpy and against shuffled steps."""

import numpy as np
import pytest

from tests.test_markov import chain, dense_steps, frame, powers, vector  # noqa: F401
from trackweave import operators as ops
from trackweave.operators import markov, packed


@pytest.fixture
def small_tasks(monkeypatch):
    """Several tasks, rows of few entries and blocks of two steps."""
    monkeypatch.setattr(packed, "ENTRIES_PER_PACKED_TASK", 8)
    monkeypatch.setattr(packed, "ENTRIES_PER_PACKED_ROW", 3)
    monkeypatch.setattr(packed, "PACKED_VALUES", 18)


def test_a_vector_beyond_the_broadcast_of_a_block_is_not_shuffled(spark, chain, monkeypatch, small_tasks):  # noqa: F811
    start, matrix = chain

    def never(*_):
        raise AssertionError("shuffled")

    monkeypatch.setattr(markov, "_shuffled_step", never)
    monkeypatch.setattr(markov, "BROADCAST_ROWS", 8)
    steps = ops.convergence_trace(vector(spark, start), frame(spark, matrix), 7)
    np.testing.assert_allclose(dense_steps(steps, 7), powers(start, matrix, 7), atol=1e-14)


def test_trace_and_chain_in_many_tasks(spark, chain, small_tasks):  # noqa: F811
    start, matrix = chain
    want = powers(start, matrix, 6)
    trace = ops.convergence_trace(vector(spark, start), frame(spark, matrix), 6).collect()
    visited = (want > 0).any(axis=0)
    assert len(trace) == 6 * visited.sum()
    for r in trace:
        assert r.p == pytest.approx(want[r.step, r.cell_no - 1])
    chained = ops.chain_phases(vector(spark, start), [(frame(spark, matrix), 3), (frame(spark, matrix.T), 2)])
    after = powers(want[2], matrix.T, 2)
    np.testing.assert_allclose(dense_steps(chained.filter("phase = 2"), 2), after, atol=1e-14)


def test_odd_rows_as_with_shuffled_steps(spark, small_tasks):
    start = spark.createDataFrame([(1, 0.5), (1, 0.25), (2, None), (None, 0.25)], "cell_no int, p double")
    matrix = spark.createDataFrame(
        [(1, 2, 0.5), (1, 2, 0.25), (2, 3, None), (2, 1, 0.5), (None, 1, 1.0), (7, 8, 1.0)],
        "from_no int, to_no int, prob double",
    )
    found = [
        sorted(map(tuple, ops.propagate(start, matrix, 5, 2, broadcast_rows=n).collect())) for n in (0, None)
    ]
    assert found[0] == found[1]
    assert found[1][:2] == [(0, 1, 0.25), (0, 1, 0.5)]


def test_a_matrix_without_entries(spark):
    matrix = spark.createDataFrame([], "from_no int, to_no int, prob double")
    assert [tuple(r) for r in ops.propagate(vector(spark, [1.0]), matrix, 4).collect()] == [(0, 1, 1.0)]
