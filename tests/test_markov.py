"""Distributions against numpy."""

import numpy as np
import pytest

from trackweave import operators as ops
from trackweave.operators import markov


def frame(spark, dense):
    rows = [(i + 1, j + 1, float(v)) for (i, j), v in np.ndenumerate(dense) if v]
    return spark.createDataFrame(rows, "from_no int, to_no int, prob double")


def vector(spark, values):
    rows = [(i + 1, float(v)) for i, v in enumerate(values) if v]
    return spark.createDataFrame(rows, "cell_no int, p double")


@pytest.fixture(scope="module")
def chain():
    rng = np.random.default_rng(7)
    dense = rng.random((9, 9)) * (rng.random((9, 9)) < 0.4)
    dense[4] = 0  # nothing leads on from here
    totals = dense.sum(axis=1, keepdims=True)
    matrix = np.divide(dense, totals, out=np.zeros_like(dense), where=totals > 0)
    start = np.zeros(9)
    start[[0, 3]] = 0.4, 0.6
    return start, matrix


def dense_steps(df, rows, size=9):
    out = np.zeros((rows, size))
    for r in df.collect():
        out[r.step, r.cell_no - 1] = r.p
    return out


def powers(start, matrix, rows):
    steps = [start]
    for _ in range(rows - 1):
        steps.append(steps[-1] @ matrix)
    return np.array(steps)


@pytest.mark.parametrize("rows, every", [(1, 4), (2, 4), (5, 4), (9, 4), (7, 1), (6, 10)])
def test_propagate(spark, chain, rows, every):
    start, matrix = chain
    steps = ops.propagate(vector(spark, start), frame(spark, matrix), rows, every)
    assert steps.filter("p = 0").count() == 0
    np.testing.assert_allclose(dense_steps(steps, rows), powers(start, matrix, rows), atol=1e-14)


def test_mass_never_grows(spark, chain):
    start, matrix = chain
    trace = ops.convergence_trace(vector(spark, start), frame(spark, matrix), 8)
    totals = [r.total for r in ops.convergence_distance(trace).orderBy("step").collect()]
    assert all(b <= a + 1e-12 for a, b in zip(totals, totals[1:]))
    assert totals[-1] < totals[0] == pytest.approx(1)


def test_trace_lists_zeros_of_visited_cells_only(spark):
    matrix = spark.createDataFrame([(1, 2, 1.0), (3, 1, 1.0)], "from_no int, to_no int, prob double")
    trace = ops.convergence_trace(vector(spark, [1.0]), matrix, 3)
    assert sorted(map(tuple, trace.collect())) == [
        (0, 1, 1.0, None), (0, 2, 0.0, None), (1, 1, 0.0, 1.0),
        (1, 2, 1.0, 1.0), (2, 1, 0.0, 0.0), (2, 2, 0.0, 1.0),
    ]


def test_chain_and_trend(spark, chain):
    start, matrix = chain
    second = matrix.T / np.maximum(matrix.T.sum(axis=1, keepdims=True), 1e-9)
    phases = [(frame(spark, matrix), 4), (frame(spark, second), 3)]
    chained = ops.chain_phases(vector(spark, start), phases).persist()
    first = powers(start, matrix, 4)
    after = powers(first[-1], second, 3)
    np.testing.assert_allclose(dense_steps(chained.filter("phase = 1"), 4), first, atol=1e-14)
    np.testing.assert_allclose(dense_steps(chained.filter("phase = 2"), 3), after, atol=1e-14)
    trend = {r.cell_no: (r.initial, r.middle, r.end) for r in ops.mobility_trend(chained, (4, 3)).collect()}
    for cell in range(9):
        want = (first[0, cell], first[-1, cell], after[-1, cell])
        assert trend.get(cell + 1, (0, 0, 0)) == pytest.approx(want)


def test_trend_when_all_mass_has_left(spark):
    matrix = spark.createDataFrame([(1, 2, 1.0)], "from_no int, to_no int, prob double")
    chained = ops.chain_phases(vector(spark, [1.0]), [(matrix, 5), (matrix, 2)])
    trend = ops.mobility_trend(chained, (5, 2))
    assert [tuple(r) for r in trend.collect()] == [(1, 1.0, 0.0, 0.0)]


def test_vector_round_trip(spark):
    packed = ops.vector_collect(vector(spark, [0.5, 0, 0.25, 0.25]))
    assert tuple(packed.collect()[0]) == ([1, 3, 4], [0.5, 0.25, 0.25])
    assert [tuple(r) for r in ops.to_vector(packed).collect()] == [(1, 0.5), (3, 0.25), (4, 0.25)]


def test_users_without_any_known_cell_do_not_count(spark):
    starts = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "user_id int, cell_no int")
    links = spark.createDataFrame([(1, 1, 0.5), (1, 5, 0.25)], "cell_no int, link_no int, prop double")
    got = {r.cell_no: r.p for r in ops.initial_distribution(starts, links).collect()}
    assert got == {1: 0.5, 5: 0.25}


@pytest.mark.parametrize("rows, every", [(1, 5), (6, 2), (9, 5)])
def test_broadcast_and_shuffled_steps_agree(spark, chain, rows, every):
    start, matrix = chain
    for broadcast_rows in (0, 100):
        steps = ops.propagate(
            vector(spark, start), frame(spark, matrix), rows, every, broadcast_rows=broadcast_rows
        )
        np.testing.assert_allclose(dense_steps(steps, rows), powers(start, matrix, rows), atol=1e-14)


def test_a_propagation_leaves_the_session_alone(spark, chain):
    start, matrix = chain
    names = ("spark.sql.ansi.enabled", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(n) for n in names]
    steps = ops.propagate(vector(spark, start), frame(spark, matrix), 3)
    assert steps.sparkSession is spark or steps.sparkSession == spark
    assert [spark.conf.get(n) for n in names] == before


def test_steps_do_not_shuffle_the_matrix(spark, chain):
    start, matrix = chain
    evolution = markov._Evolution(vector(spark, start), frame(spark, matrix), 100)
    columns = ["max(if(stays, peak, null)) AS peak", "max(if(stays, p_0, null)) AS p_0"]
    step = evolution.step(evolution.frame, evolution.moves, "sum(p_0 * prob) AS p_1", columns)
    plan = step._jdf.queryExecution().executedPlan().toString()
    # What the cached matrix was made of stands below the scan of the cache.
    above = plan.split("InMemoryRelation")[0]
    assert "hashpartitioning" not in above and "SinglePartition" not in above
    assert "BroadcastHashJoin" in above
    evolution.close()


@pytest.mark.parametrize("every", [2, 5])
def test_trace_ends_when_it_has_settled(spark, every):
    matrix = np.array([[0.5, 0.5, 0], [0.25, 0.5, 0.25], [0, 0.5, 0.5]])
    start = np.array([1.0, 0, 0])
    dense = powers(start, matrix, 40)
    distances = np.abs(np.diff(dense, axis=0)).sum(axis=1)
    last = int(np.argmax(distances <= 0.01)) + 1
    trace = ops.convergence_trace(vector(spark, start), frame(spark, matrix), 40, every, 0.01).collect()
    assert max(r.step for r in trace) == last
    assert len(trace) == 3 * (last + 1)
    for r in trace:
        assert r.p == pytest.approx(dense[r.step, r.cell_no - 1])
        if r.step:
            assert r.change == pytest.approx(abs(dense[r.step, r.cell_no - 1] - dense[r.step - 1, r.cell_no - 1]))


def test_early_stop_lists_visited_cells_only(spark):
    matrix = spark.createDataFrame([(1, 1, 1.0), (7, 8, 1.0)], "from_no int, to_no int, prob double")
    trace = ops.convergence_trace(vector(spark, [1.0]), matrix, 9, 3, 0.0).collect()
    assert sorted(map(tuple, trace)) == [(0, 1, 1.0, None), (1, 1, 1.0, 0.0)]


def test_rows_of_the_start_do_not_pass_one_task(spark):
    starts = spark.range(100).selectExpr("id AS user_id", "cast(id % 9 AS int) AS cell_no")
    links = spark.createDataFrame([(c, c, 1.0) for c in range(5)], "cell_no int, link_no int, prop double")
    for chosen, users in ((None, 100), (links, 56)):
        vector_ = ops.initial_distribution(starts, chosen)
        plan = vector_._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan
        shares = {r.cell_no: r.p for r in vector_.collect()}
        assert shares[0] == pytest.approx(12 / users)
        assert sum(shares.values()) == pytest.approx(1)
