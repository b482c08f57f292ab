"""Matrix plans: shortcuts against pair-by-pair expansion, and invariants."""

import pytest
from pyspark.sql import functions as F

from checks import inputs
from trackweave import operators as ops
from trackweave import plans
from trackweave.operators import dimensions
from tests.conftest import as_matrix

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def network(spark):
    return inputs.network(spark, TABLES)


@pytest.fixture(scope="module")
def observations(spark):
    return inputs.observations(spark, TABLES).persist()


def naive(observations, network, order):
    states = ops.probabilistic_states(
        plans.trajectory(observations, network), network.states(order)
    )
    pairs = ops.drop_incomplete(ops.lag_state_by_day(states, state="states"))
    updates = ops.explode_updates(pairs, "prev_states", "states")
    return ops.row_normalize(ops.simplify_matrix_ids(ops.collect_pairs(updates), network.cells))


@pytest.mark.parametrize("order", [1, 2])
def test_counting_first_equals_expanding_every_pair(observations, network, order):
    fast = plans.transition_matrix(observations, network, order).persist()
    slow = naive(observations, network, order).persist()
    for value in ("weight", "prob"):
        assert as_matrix(fast, value) == pytest.approx(as_matrix(slow, value), abs=1e-12)


def test_known_sizes(observations, network):
    assert plans.transition_matrix(observations, network).count() == 558
    assert plans.transition_matrix(observations, network, 1).count() == 8859


def test_rows_sum_to_one(observations, network):
    for matrix in (
        plans.transition_matrix(observations, network, 3),
        plans.od_matrix(observations, network, 1),
    ):
        for row in matrix.groupBy("from_no").agg(F.sum("prob").alias("total")).collect():
            assert row.total == pytest.approx(1)


def test_whole_week_slot_equals_no_slot_on_complete_rows(observations, network):
    complete = observations.na.drop()
    every = plans.transition_matrix(complete, network)
    slot = plans.transition_matrix(complete, network, slot=(1, 7, 0, 24))
    assert as_matrix(every, "weight") == as_matrix(slot, "weight")


def test_hot_user_days_and_large_tables_change_nothing(observations, network, monkeypatch):
    tm = as_matrix(plans.transition_matrix(observations, network, 1), "prob")
    od = as_matrix(plans.od_matrix(observations, network, 1), "prob")
    copies = observations.unionByName(observations)
    assert as_matrix(plans.od_matrix(copies, network, 1, hot_rows=3), "prob") == pytest.approx(od)
    monkeypatch.setattr(dimensions, "BROADCAST_ROWS", 0)
    assert as_matrix(
        plans.transition_matrix(observations, network, 1, hot_rows=3), "prob"
    ) == pytest.approx(tm)
    assert as_matrix(plans.od_matrix(observations, network, 1, hot_rows=3), "prob") == pytest.approx(od)


def test_gis_export_has_both_ends(observations, network):
    matrix = plans.transition_matrix(observations, network)
    exported = ops.gis_export(matrix, network.cells)
    assert exported.columns == ["prob", "from_cell", "from_x", "from_y", "to_cell", "to_x", "to_y"]
    assert exported.count() == matrix.count()


def test_the_plan_moves_observations_once(observations, network):
    """Once per user-day; the other shuffle moves pair counts. Lookups are broadcast."""
    pairs = plans.transition_pairs(observations, network, order=1)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan
    assert "PythonUDF" not in plan
