"""Queries over steps do their work on observed sequences and on drawn walks."""

import pytest

from checks.queries import REGISTRY

TABLES = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "name", ["add_ring_noise", "lag_state_by_step", "step_mean", "transition_matrix_walks", "walk_vectors"]
)
def test_both_kinds_of_steps(spark, name):
    rows = REGISTRY[name](spark, TABLES).groupBy("drawn").count().collect()
    assert {r.drawn for r in rows} == {False, True}
