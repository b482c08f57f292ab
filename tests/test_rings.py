"""Ring distributions."""

import pytest
from pyspark.sql import functions as F

from trackweave import operators as ops

ADJACENCY = "cell_id string, neighbor_id string, ring_order int"


def grid(spark, size=6):
    points = [(x, y) for x in range(size) for y in range(size)]
    rows = [
        (f"{a}.{b}", f"{c}.{d}", max(abs(a - c), abs(b - d)))
        for a, b in points for c, d in points if max(abs(a - c), abs(b - d)) <= 3
    ]
    return spark.createDataFrame(rows, ADJACENCY)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_wide_and_long_forms_agree_and_sum_to_one(spark, order):
    adjacency = grid(spark).persist()
    records = ops.records_from_adjacency(adjacency)
    parts = ops.ring_repeat_weights(
        ops.join_ring_parts(
            ops.ring_probability(ops.align_ring_counts(records)), ops.align_ring_members(records)
        )
    )
    wide = ops.ring_states(parts, order).select("cell_id", F.inline("states").alias("n", "p"))
    long = ops.ring_distribution(adjacency, order)
    packed = ops.states_from_distribution(long).select("cell_id", F.inline("states").alias("n", "p"))
    results = [{(r[0], r[1]): r[2] for r in df.collect()} for df in (wide, long, packed)]
    assert results[0] == pytest.approx(results[1])
    assert results[2] == results[1]
    for row in long.groupBy("cell_id").agg(F.sum("prop").alias("total")).collect():
        assert row.total == pytest.approx(1)


def test_cell_without_neighbours_keeps_only_its_own_mass(spark):
    adjacency = spark.createDataFrame([("A", "A", 0)], ADJACENCY)
    assert [r.prop for r in ops.ring_distribution(adjacency, 1).collect()] == [pytest.approx(0.5)]
    records = spark.createDataFrame(
        [(k, "A", 0, []) for k in (1, 2, 3)],
        "ring_order int, cell_id string, n int, members array<string>",
    )
    parts = ops.ring_repeat_weights(
        ops.join_ring_parts(
            ops.ring_probability(ops.align_ring_counts(records)), ops.align_ring_members(records)
        )
    )
    state = ops.ring_states(parts, 2).collect()[0].states
    assert [tuple(s) for s in state] == [("A", pytest.approx(0.37 / 0.89))]


def test_rings_without_a_record_are_empty(spark):
    records = spark.createDataFrame(
        [(1, "A", 1, ["B"]), (2, "A", 1, ["C"]), (3, "A", 1, ["D"]), (1, "B", 1, ["A"])],
        "ring_order int, cell_id string, n int, members array<string>",
    )
    counts = {r.cell_id: (r.n_1, r.n_2, r.n_3) for r in ops.align_ring_counts(records).collect()}
    assert counts == {"A": (1, 1, 1), "B": (1, 0, 0)}
    lists = {r.cell_id: (r.members_1, r.members_2, r.members_3) for r in ops.align_ring_members(records).collect()}
    assert lists == {"A": (["B"], ["C"], ["D"]), "B": (["A"], [], [])}


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("empty", [1, 2, 3])
def test_wide_and_long_forms_agree_on_empty_rings(spark, order, empty):
    """A, B and C without any neighbour of one order, and an island D."""
    rows = [(c, c, 0) for c in "ABCD"] + [
        (a, b, k)
        for k in (1, 2, 3)
        if k != empty
        for a, b in (("A", "B"), ("B", "C"), ("C", "A"), ("A", "C"))
    ]
    adjacency = spark.createDataFrame(rows, ADJACENCY)
    records = ops.records_from_adjacency(adjacency)
    assert records.count() == 4 * 3
    parts = ops.ring_repeat_weights(
        ops.join_ring_parts(
            ops.ring_probability(ops.align_ring_counts(records)), ops.align_ring_members(records)
        )
    )
    wide = ops.ring_states(parts, order).select("cell_id", F.inline("states").alias("n", "p"))
    long = ops.ring_distribution(adjacency, order)
    # A neighbour may stand in several rings of this small network.
    results = [sorted((r[0], r[1], round(r[2], 12)) for r in df.collect()) for df in (wide, long)]
    assert results[0] == results[1]
    assert {r[0] for r in results[0]} == set("ABCD")

