"""Walks against a plain interval search, and statistics over them."""

import bisect
import hashlib
import random

import pytest

from trackweave import Network
from trackweave import operators as ops
from trackweave import plans
from trackweave.operators import dimensions
from tests.conftest import as_matrix


def number(*parts):
    digest = hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()
    return (int(digest[:8], 16) + 0.5) / 2**32


def random_matrix(seed=5, cells=12):
    """Rows of very unequal probabilities; the last cell leads nowhere."""
    rng = random.Random(seed)
    rows = {}
    for origin in range(1, cells):
        ends = sorted(rng.sample(range(1, cells + 1), rng.randrange(1, cells)))
        weights = [rng.random() ** 8 + 1e-9 for _ in ends]
        rows[origin] = [(e, w / sum(weights)) for e, w in zip(ends, weights)]
    return rows


def walk(rows, user, start, steps, seed=0):
    out = [start]
    for step in range(1, steps + 1):
        if out[-1] not in rows:
            break
        ends, cumulative, total = [], [], 0.0
        for end, p in rows[out[-1]]:
            total += p
            ends.append(end)
            cumulative.append(round(total, 12))
        at = bisect.bisect_left(cumulative, number(user, step, seed))
        out.append(ends[min(at, len(ends) - 1)])
    return out


@pytest.fixture(scope="module")
def setting(spark):
    rows = random_matrix()
    matrix = spark.createDataFrame(
        [(o, e, p) for o, ends in rows.items() for e, p in ends],
        "from_no int, to_no int, prob double",
    ).persist()
    starts = {user: 1 + user % 12 for user in range(60)}
    frame = spark.createDataFrame(list(starts.items()), "user_id int, cell_no int")
    return rows, matrix, starts, frame


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_walks(setting, broadcast, monkeypatch):
    monkeypatch.setattr(dimensions, "BROADCAST_ROWS", broadcast)
    rows, matrix, starts, frame = setting
    got = {r.user_id: r.walk for r in ops.synthesize_walks(frame, matrix, 9, seed=3).collect()}
    assert got == {u: walk(rows, u, c, 9, seed=3) for u, c in starts.items()}
    assert {len(w) for w in got.values()} > {10}  # some stop early


def test_single_draw(setting):
    rows, matrix, starts, frame = setting
    drawn = ops.next_state_draw(frame, ops.transition_cdf(matrix), step=2)
    for r in drawn.collect():
        after = walk({r.cell_no: rows[r.cell_no]} if r.cell_no in rows else {}, r.user_id, r.cell_no, 0)
        if r.cell_no not in rows:
            assert r.next_no is None
            continue
        cumulative = []
        total = 0.0
        for _, p in rows[r.cell_no]:
            total += p
            cumulative.append(round(total, 12))
        at = bisect.bisect_left(cumulative, number(r.user_id, 2, 0))
        assert r.next_no == rows[r.cell_no][min(at, len(cumulative) - 1)][0]
        assert after == [r.cell_no]


def test_every_number_has_exactly_one_interval(spark, setting):
    table = ops.draw_table(ops.transition_cdf(setting[1])).collect()
    rng = random.Random(1)
    for origin in setting[0]:
        mine = [r for r in table if r.from_no == origin]
        for _ in range(300):
            r = rng.random()
            hits = [
                row for row in mine
                if row.slot == int(r * row.from_slots) and row.lo < r <= row.hi
            ]
            assert len(hits) == 1


def test_neighbours_in_a_walk_are_its_lagged_pairs(setting):
    walks = ops.synthesize_walks(setting[3], setting[1], 7).persist()
    direct = ops.count_walk_pairs(walks)
    lagged = ops.drop_incomplete(ops.lag_state_by_step(ops.walk_to_rows(walks)))
    by_step = ops.count_pairs(lagged, "prev_cell_no", "cell_no")
    assert as_matrix(direct, "weight") == as_matrix(by_step, "weight")


def test_a_step_in_a_ringless_cell_vanishes_before_pairing(spark):
    cells = spark.createDataFrame(
        [("A", 1.0, 0.0), ("B", 2.0, 0.0), ("C", 3.0, 0.0)],
        "cell_id string, coord_x double, coord_y double",
    )
    adjacency = spark.createDataFrame(
        [("A", "A", 0), ("C", "C", 0)], "cell_id string, neighbor_id string, ring_order int"
    )
    walks = spark.createDataFrame([(1, [1, 2, 3])], "user_id int, walk array<int>")
    matrix = plans.transition_matrix_walks(walks, Network(cells, adjacency))
    assert as_matrix(matrix, "prob") == {(1, 3): 1.0}


def test_random_states_are_uniform_known_cells(spark):
    states = ops.random_states(spark.range(300).toDF("user_id"), 40, 10).collect()
    assert len(states) == 300 * 40
    counts = {}
    for r in states:
        counts[r.cell_no] = counts.get(r.cell_no, 0) + 1
    assert sorted(counts) == list(range(1, 11))
    assert all(1000 < n < 1400 for n in counts.values())


def test_step_and_running_means(spark):
    rows = spark.createDataFrame(
        [(1, 1, 1), (1, 2, 2), (1, 3, 2), (2, 1, 1), (2, 2, 1), (2, 3, 2)],
        "user_id int, i int, cell_no int",
    )
    links = spark.createDataFrame(
        [(1, 1, 0.5), (1, 2, 0.5), (2, 2, 1.0)], "cell_no int, link_no int, prop double"
    )
    means = ops.step_mean(rows, links).persist()
    assert {(r.i, r.cell_no): r.p for r in means.collect()} == {
        (1, 1): 0.5, (1, 2): 0.5, (2, 1): 0.25, (2, 2): 0.75, (3, 2): 1.0,
    }
    running = ops.running_mean(means, 3).persist()
    assert {(r.i, r.cell_no): r.p for r in running.collect()} == {
        (1, 1): 0.5, (1, 2): 0.5, (2, 1): 0.375, (2, 2): 0.625, (3, 1): 0.25, (3, 2): 0.75,
    }
    last = ops.last_step_distribution(running, 3)
    assert {r.cell_no: r.p for r in last.collect()} == {1: 0.25, 2: 0.75}
