"""Lookup tables and links that are too many to broadcast."""

import random

import pytest
from pyspark.sql import functions as F

from trackweave import operators as ops
from trackweave.operators import dimensions, markov, matrix, pairs
from trackweave.operators.dimensions import Dimension, lookup_join


@pytest.fixture
def no_broadcast(monkeypatch):
    monkeypatch.setattr(dimensions, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(matrix, "LINKS_PER_BLOCK", 20)


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_copies_of_a_large_table_are_not_broadcast(spark, no_broadcast, how):
    facts = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e")], "k int, f string")
    table = spark.createDataFrame([(1, 10), (2, 20), (2, 21)], "k int, v int")
    joined = lookup_join(facts, Dimension(table, 3), ["k"], how)
    assert "BroadcastHashJoin" not in executed(joined)
    assert sorted(joined.collect(), key=str) == sorted(facts.join(table, "k", how).collect(), key=str)


def small_network(spark, key):
    chance = random.Random(2)
    links = [(key(c), key(n), chance.random()) for c in range(60) for n in range(c - 3, c + 4) if c % 9]
    slots = [(s, key(a), key(b), float(1 + a % 3)) for s in (0, 1) for a in range(0, 62, 2) for b in range(61)]
    return links, slots


def expected(links, slots):
    rows = {}
    reach = {}
    for cell, link, prop in links:
        reach.setdefault(cell, []).append((link, prop))
    for slot, a, b, weight in slots:
        for x, p in reach.get(a, []):
            for y, q in reach.get(b, []):
                rows[slot, x, y] = rows.get((slot, x, y), 0.0) + weight * p * q
    return rows


def test_pairs_are_spread_in_blocks(spark, no_broadcast):
    links, slots = small_network(spark, int)
    table = Dimension(spark.createDataFrame(links, "cell_no int, link_no int, prop double"), len(links))
    counts = spark.createDataFrame([*slots, (0, None, 1, 1.0), (0, 1, None, 1.0)], "slot int, from_no int, to_no int, weight double")
    spread = ops.spread_pairs(counts, table, within=("slot",))
    got = {(r.slot, r.from_no, r.to_no): r.weight for r in spread.collect()}
    assert got == pytest.approx(expected(links, slots))
    # The products are summed where they arise: nothing moves after the last expansion.
    plan = executed(spread)
    assert "Exchange" not in plan[: plan.index("Generate")]


def test_pairs_of_ids_are_spread_in_blocks(spark, no_broadcast):
    links, slots = small_network(spark, lambda k: f"c{k}")
    table = Dimension(spark.createDataFrame(links, "cell_id string, neighbor_id string, prop double"), len(links))
    counts = spark.createDataFrame(slots, "slot int, from_cell string, to_cell string, weight double").filter(F.col("slot") == 0)
    spread = ops.spread_pairs_by_id(counts.drop("slot"), table)
    got = {(0, r.from_cell, r.to_cell): r.weight for r in spread.collect()}
    assert got == pytest.approx(expected(links, [s for s in slots if s[0] == 0]))


@pytest.fixture
def walked(spark):
    rows = [(user, f"2024-01-0{1 + k // 3} 08:00:0{k % 3}", k + user) for user in (1, 2) for k in range(6)]
    return spark.createDataFrame(rows, "user_id bigint, ts string, cell_no int").withColumn("ts", F.to_timestamp("ts"))


def test_many_hot_user_days_are_not_broadcast(spark, no_broadcast, walked):
    hot = Dimension(pairs.with_day(walked).select(*pairs.USER_DAY).distinct().limit(3), 3)
    cold, busy = pairs.split_user_days(walked, hot)
    assert "BroadcastHashJoin" not in executed(cold) + executed(busy)
    assert (cold.count(), busy.count()) == (3, 9)


@pytest.mark.parametrize(
    "second, ordinary",
    [
        (ops.lag_state_by_second, ops.lag_state_by_day),
        (ops.od_destination_by_second, ops.od_destination),
    ],
)
def test_a_row_per_second_is_not_broadcast(spark, walked, second, ordinary):
    found = second(walked)
    expected = ordinary(walked)
    assert sorted(found.collect(), key=str) == sorted(expected.select(found.columns).collect(), key=str)
    # The plan as it was run.
    assert "BroadcastHashJoin" not in executed(found)


def test_a_row_per_block_of_steps_is_not_broadcast(spark):
    steps = spark.createDataFrame([(u, i, u + i) for u in (1, 2) for i in range(1, 8)], "user_id int, i int, cell_no int")
    lagged = ops.lag_state_by_step(steps, block_steps=3)
    assert all(r.prev_cell_no == (r.cell_no - 1 if r.i > 1 else None) for r in lagged.collect())
    # The plan as it was run.
    assert "BroadcastHashJoin" not in executed(lagged)


def test_a_large_draw_table_is_not_broadcast(spark, no_broadcast):
    moves = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "from_no int, to_no int, prob double")
    starts = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "user_id bigint, cell_no int")
    drawn = ops.next_state_draw(starts, ops.transition_cdf(moves))
    assert "BroadcastHashJoin" not in executed(drawn)
    assert sorted(drawn.collect(), key=str) == sorted([(1, 1, 2), (2, 2, 1), (3, 3, None)], key=str)


def test_vectors_of_a_block_count_together(spark, monkeypatch):
    used = []
    for name in ("_broadcast_step", "_shuffled_step"):
        real = getattr(markov, name)
        monkeypatch.setattr(markov, name, lambda *a, real=real, name=name: (used.append(name), real(*a))[1])
    start = spark.createDataFrame([(1, 1.0)], "cell_no int, p double")
    moves = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "from_no int, to_no int, prob double")
    got = [ops.propagate(start, moves, 4, every=3, broadcast_rows=limit).collect() for limit in (6, 5)]
    assert used == ["_broadcast_step"] * 3 + ["_shuffled_step"] * 3
    assert sorted(got[0]) == sorted(got[1])
