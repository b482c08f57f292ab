"""A hand-worked example: one user, three cells in a line."""

import pytest

from trackweave import operators as ops
from trackweave import plans
from tests.conftest import as_matrix

ROWS = [
    (1, "2024-01-01 08:00:00", 1),
    (1, "2024-01-01 08:30:00", 2),
    (1, "2024-01-01 11:00:00", 1),
    (1, "2024-01-01 12:59:59", 3),
    (1, "2024-01-02 23:30:00", 3),
    (1, "2024-01-03 00:10:00", 1),
]


@pytest.fixture(scope="module")
def observations(observed):
    return observed(ROWS).persist()


def test_deterministic_matrix(observations, line_network):
    matrix = plans.transition_matrix(observations, line_network)
    assert as_matrix(matrix, "weight") == {(1, 2): 1, (1, 3): 1, (2, 1): 1}
    assert as_matrix(matrix, "prob") == {(1, 2): 0.5, (1, 3): 0.5, (2, 1): 1}


def test_od_matrix(observations, line_network):
    matrix = plans.od_matrix(observations, line_network)
    assert as_matrix(matrix, "weight") == {
        (1, 1): 1, (1, 2): 1, (1, 3): 1, (2, 2): 1, (3, 3): 2,
    }
    probs = as_matrix(matrix, "prob")
    assert probs[1, 1] == pytest.approx(1 / 3)
    assert probs[3, 3] == 1


def test_ring_states(line_network):
    rows = line_network.links(1).df.collect()
    assert {(r.cell_no, r.link_no): r.prop for r in rows} == pytest.approx(
        {(1, 1): 0.5, (1, 2): 0.5, (2, 1): 0.25, (2, 2): 0.5, (2, 3): 0.25, (3, 2): 0.5, (3, 3): 0.5}
    )


def test_one_ring_matrix(observations, line_network):
    matrix = plans.transition_matrix(observations, line_network, order=1).persist()
    assert as_matrix(matrix, "weight") == pytest.approx(
        {
            (1, 1): 0.25, (1, 2): 0.625, (1, 3): 0.375,
            (2, 1): 0.375, (2, 2): 0.75, (2, 3): 0.375,
            (3, 1): 0.125, (3, 2): 0.125,
        }
    )
    assert as_matrix(matrix, "prob") == pytest.approx(
        {
            (1, 1): 0.2, (1, 2): 0.5, (1, 3): 0.3,
            (2, 1): 0.25, (2, 2): 0.5, (2, 3): 0.25,
            (3, 1): 0.5, (3, 2): 0.5,
        }
    )


def test_start_and_leaking_propagation(observations, line_network):
    start = plans.starting_distribution(observations, line_network)
    assert [(r.cell_no, r.p) for r in start.collect()] == [(1, 1.0)]
    matrix = plans.transition_matrix(observations, line_network)
    steps = ops.propagate(start, matrix, 4)
    assert {(r.step, r.cell_no): r.p for r in steps.collect()} == {
        (0, 1): 1, (1, 2): 0.5, (1, 3): 0.5, (2, 1): 0.5, (3, 2): 0.25, (3, 3): 0.25,
    }
