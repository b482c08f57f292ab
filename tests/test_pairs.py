"""Previous position and trip destination against brute force."""

import random
from datetime import datetime, timedelta

import pytest

from trackweave import operators as ops
from trackweave import plans
from trackweave.operators import dimensions
from tests.conftest import as_matrix, at

TRAJECTORY = "user_id bigint, ts timestamp, weekday int, hour int, cell_id string, cell_no int"


def trajectory(spark, rows):
    return spark.createDataFrame(
        [(u, t, t.isoweekday(), t.hour, str(c), c) for u, t, c in rows], TRAJECTORY
    )


def crowded(seed, users=4, rows=400):
    """Few users, few days, many rows in the same second, some without a user."""
    rng = random.Random(seed)
    begin = datetime(2024, 1, 1, 20, 0, 0)
    seen = {}
    for _ in range(rows):
        user = rng.choice([None, *range(users)])
        ts = begin + timedelta(seconds=rng.choice([0, 1, 3599, 7200, 7201, rng.randrange(30_000)]),
                               microseconds=rng.randrange(1_000_000))
        seen[user, ts] = rng.randrange(1, 6)
    return [(u, t, c) for (u, t), c in seen.items()]


def expected(rows, horizon=7200):
    """(user, ts) -> (previous cell, destination cell)."""
    out = {}
    for user, ts, cell in rows:
        day = sorted((t, c) for u, t, c in rows if u == user and t.date() == ts.date())
        before = [c for t, c in day if t < ts]
        limit = ts.replace(microsecond=0) + timedelta(seconds=horizon)
        ahead = [c for t, c in day if t.replace(microsecond=0) <= limit]
        out[user, ts] = (before[-1] if before else None, ahead[-1])
    return out


def found(df, column):
    return {(r.user_id, r.ts): r[column] for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_both_forms_equal_brute_force(spark, seed):
    rows = crowded(seed)
    frame = trajectory(spark, rows).persist()
    want = expected(rows)
    previous = {k: v[0] for k, v in want.items()}
    destination = {k: v[1] for k, v in want.items()}
    assert found(ops.lag_state_by_day(frame), "prev_cell_no") == previous
    assert found(ops.lag_state_by_day(frame, unique_times=True), "prev_cell_no") == previous
    assert found(ops.lag_state_by_second(frame), "prev_cell_no") == previous
    assert found(ops.od_destination(frame), "dest_cell_no") == destination
    assert found(ops.od_destination_by_second(frame), "dest_cell_no") == destination


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_hot_user_days_are_split_off_whole(spark, broadcast, monkeypatch):
    monkeypatch.setattr(dimensions, "BROADCAST_ROWS", broadcast)
    rows = crowded(seed=4)
    frame = trajectory(spark, rows)
    assert ops.hot_user_days(frame, 100_000) is None
    sizes = {}
    for user, ts, _ in rows:
        sizes[user, ts.date()] = sizes.get((user, ts.date()), 0) + 1
    limit = sorted(sizes.values())[len(sizes) // 2]
    hot = ops.hot_user_days(frame, limit)
    large = {k for k, n in sizes.items() if n > limit}
    assert {tuple(r) for r in hot.df.collect()} == large
    cold, busy = ops.split_user_days(frame, hot)
    assert {(r.user_id, r._day) for r in busy.collect()} == large
    assert cold.count() + busy.count() == len(rows)


def test_midnight_and_horizon(spark):
    rows = [
        (1, at("2024-01-01 23:59:59"), 1), (1, at("2024-01-02 00:00:00"), 2),
        (2, at("2024-01-01 10:00:00"), 1), (2, at("2024-01-01 12:00:00"), 2),
        (3, at("2024-01-01 10:00:00"), 1), (3, at("2024-01-01 12:00:01"), 2),
        (4, at("2024-01-01 10:00:00.9"), 1), (4, at("2024-01-01 12:00:00.95"), 2),
    ]
    frame = trajectory(spark, rows)
    trips = {(r.user_id, r.cell_no): r.dest_cell_no for r in ops.od_destination(frame).collect()}
    assert trips == {(1, 1): 1, (1, 2): 2, (2, 1): 2, (2, 2): 2, (3, 1): 1, (3, 2): 2, (4, 1): 2, (4, 2): 2}
    lagged = {(r.user_id, r.cell_no): r.prev_cell_no for r in ops.lag_state_by_day(frame).collect()}
    assert lagged[1, 2] is None and lagged[2, 2] == 1


def test_missing_hour_drops_the_destination_but_not_the_predecessor(spark, line_network):
    rows = [
        (1, at("2024-01-01 08:00:00"), 1, 8, 1.0, 0.0),
        (1, at("2024-01-01 09:00:00"), 1, None, 2.0, 0.0),
        (1, at("2024-01-01 10:00:00"), 1, 10, 3.0, 0.0),
    ]
    observations = spark.createDataFrame(
        rows, "user_id bigint, ts timestamp, weekday int, hour int, coord_x double, coord_y double"
    )
    assert as_matrix(plans.transition_matrix(observations, line_network), "weight") == {(2, 3): 1}
    # A slot removes the row before pairing, so the others become neighbours.
    slotted = plans.transition_matrix(observations, line_network, slot=(1, 7, 0, 24))
    assert as_matrix(slotted, "weight") == {(1, 3): 1}
    # Trips keep it.
    assert as_matrix(plans.od_matrix(observations, line_network), "weight") == {
        (1, 3): 1, (2, 3): 1, (3, 3): 1,
    }


def test_rows_without_user_only_matter_for_trips(spark, line_network):
    rows = [(None, at(f"2024-01-01 0{h}:00:00"), 1, h, float(x), 0.0) for h, x in [(1, 1), (2, 2)]]
    observations = spark.createDataFrame(
        rows, "user_id bigint, ts timestamp, weekday int, hour int, coord_x double, coord_y double"
    )
    assert plans.transition_matrix(observations, line_network).count() == 0
    assert as_matrix(plans.od_matrix(observations, line_network), "weight") == {(1, 2): 1, (2, 2): 1}
