"""Stored trajectories: what they save, and that they change no result."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trackweave import operators as ops
from trackweave import plans

from .conftest import as_matrix

SLOTS = [(1, 5, 6, 12), (1, 5, 10, 18), (6, 7, 0, 24)]


@pytest.fixture(scope="module")
def observations(spark, observed):
    """Five users; the first owns a third of the rows, one of its days most of those."""
    chance = random.Random(5)
    begin = datetime(2024, 1, 1)
    rows = []
    for k in range(600):
        user = 0 if k % 3 == 0 else 1 + k % 4
        if user == 0 and k % 2:
            when = begin + timedelta(hours=9, seconds=chance.randint(0, 900))
        else:
            when = begin + timedelta(seconds=chance.randint(0, 9 * 86_400))
        rows.append((user, when.isoformat(sep=" "), chance.choice([1, 2, 3, 3, 9])))
    frame = observed(rows + rows[:40])
    return frame.withColumn("hour", F.when(F.col("coord_x") + F.col("hour") != 12, F.col("hour")))


@pytest.fixture(scope="module", params=[None, 1, 20])
def stored(request, observations, line_network):
    return plans.store_trajectory(observations, line_network, request.param)


def close(got, want):
    assert as_matrix(got, "weight") == pytest.approx(as_matrix(want, "weight"))
    assert as_matrix(got, "prob") == pytest.approx(as_matrix(want, "prob"))


@pytest.mark.parametrize("order", [0, 1])
@pytest.mark.parametrize("slot", [None, SLOTS[0]])
def test_matrices_are_those_of_the_raw_rows(stored, observations, line_network, order, slot):
    for plan in (plans.transition_matrix, plans.od_matrix):
        close(
            plan(stored, line_network, order, slot=slot),
            plan(observations, line_network, order, slot=slot, hot_rows=None),
        )


def test_rows_are_the_trajectory(stored, observations, line_network):
    columns = ["user_id", "ts", "weekday", "hour", "cell_id", "cell_no"]
    raw = plans.trajectory(observations, line_network).select(*columns)
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    assert sorted(stored.rows().select(*columns).collect(), key=key) == sorted(raw.collect(), key=key)


def test_slots_of_one_scan_are_those_of_several(stored, line_network):
    together = plans.slot_matrices(stored, SLOTS, 1)
    for place, slot in enumerate(SLOTS):
        close(
            together.filter(F.col("slot") == place),
            plans.transition_matrix(stored, line_network, 1, slot),
        )


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairing_reads_the_table_in_place(observations, line_network):
    """One scan for all slots, and nothing moves until pairs are counted."""
    stored = plans.store_trajectory(observations, line_network)
    for counts in (
        plans.slot_pairs(stored, SLOTS),
        plans.transition_pairs(stored, line_network),
    ):
        plan = executed(counts)
        assert plan.count("FileScan") == 1 and "Bucketed: true" in plan
        below = plan[plan.index("Window") :]
        assert "Exchange" not in below
        assert plan.count("Exchange hashpartitioning") == 1


def jobs_of(spark, make):
    """How many jobs ``make`` starts."""
    tracker, group = spark.sparkContext.statusTracker(), f"plan-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        make()
        return len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_building_a_matrix_starts_no_job(spark, stored, line_network):
    line_network.links(1)
    line_network.ringed_cells()
    assert jobs_of(spark, lambda: plans.transition_matrix(stored, line_network, 1)) == 0
    assert jobs_of(spark, lambda: plans.od_matrix(stored, line_network, 1)) == 0
    assert jobs_of(spark, lambda: plans.slot_matrices(stored, SLOTS, 1)) == 0


def test_sequences_are_numbered_by_time(stored):
    numbered = plans.sequence(stored)
    rows = defaultdict(list)
    for r in stored.rows().collect():
        rows[r.user_id].append((r.ts, r.cell_no))
    want = [(u, i, c) for u, seen in rows.items() for i, (_, c) in enumerate(sorted(seen), start=1)]
    assert sorted(map(tuple, numbered.collect())) == sorted(want)


@pytest.mark.parametrize("block_steps", [1, 3, 1000])
def test_previous_states_cross_the_blocks(spark, block_steps):
    """A user with a third of the rows, steps with gaps, a user without a name."""
    chance = random.Random(2)
    walks = {None: 4, 1: 30, 2: 25, 3: 1}
    rows = [
        (user, i, chance.randint(1, 5))
        for user, n in walks.items()
        for i in sorted(chance.sample(range(1, 90), n))
    ]
    frame = spark.createDataFrame(rows, "user_id long, i int, cell_no int")
    got = ops.lag_state_by_step(frame, block_steps=block_steps).collect()
    want, last = [], {}
    for user, i, cell in rows:
        want.append((user, i, cell, last.get(user)))
        last[user] = cell
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_sequence_matrix_of_one_busy_user(stored, line_network):
    """Every consecutive pair of every user, days and blocks notwithstanding."""
    rows = defaultdict(list)
    for r in stored.rows().collect():
        rows[r.user_id].append((r.ts, r.cell_no))
    counts = defaultdict(float)
    for seen in rows.values():
        cells = [c for _, c in sorted(seen)]
        for pair in zip(cells, cells[1:]):
            counts[pair] += 1
    matrix = plans.transition_matrix_steps(plans.sequence(stored), line_network, 0)
    assert as_matrix(matrix, "weight") == counts


def test_pairs_are_counted_before_rings_are_applied(stored, line_network):
    lagged = ops.lag_state_by_day(stored.rows(1), state="cell_id")
    counts = ops.count_pairs(
        ops.drop_incomplete(lagged), "prev_cell_id", "cell_id", names=("from_cell", "to_cell")
    )
    totals = ops.spread_pairs_by_id(counts, line_network.distribution(1))
    assert "Generate" not in executed(totals)
    pairs = ops.pair_states(ops.drop_incomplete(lagged), line_network.states(1))
    each = ops.collect_pairs(ops.explode_updates(pairs, "prev_states", "states"))
    got, want = ({(r[0], r[1]): r[2] for r in df.collect()} for df in (totals, each))
    assert got == pytest.approx(want)


def test_step_means_count_walkers_with_a_state_only(spark):
    rows = spark.createDataFrame([(1, 1, 1), (2, 1, 9)], "user_id int, i int, cell_no int")
    links = spark.createDataFrame([(1, 1, 1.0)], "cell_no int, link_no int, prop double")
    assert [tuple(r) for r in ops.step_mean(rows, links).collect()] == [(1, 1, 1.0)]


def test_running_sums_are_intervals(spark):
    means = spark.createDataFrame([(1, 7, 0.5), (4, 7, 0.25), (2, 8, 1.0)], "i int, cell_no int, p double")
    sums = sorted(map(tuple, ops.running_sums(means, 5).collect()))
    assert sums == [(7, 1, 3, 0.5), (7, 4, 5, 0.75), (8, 2, 5, 1.0)]
    every = {(r.i, r.cell_no): r.p for r in ops.running_mean(means, 5).collect()}
    for step in range(1, 6):
        at = {r.cell_no: r.p for r in ops.running_mean_at(means, step).collect()}
        assert at == pytest.approx({c: p for (i, c), p in every.items() if i == step})


def test_empty_observations(spark, observations, line_network):
    empty = plans.store_trajectory(observations.limit(0), line_network)
    assert plans.transition_matrix(empty, line_network, 1).count() == 0
    assert plans.sequence(empty).count() == 0
