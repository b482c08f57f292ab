"""Cleaning, cells and lookups."""

import pytest
from pyspark.sql import functions as F

from trackweave import operators as ops
from trackweave.operators import dimensions
from tests.conftest import OBSERVATION, at


def test_dedup_keeps_the_smallest_coordinates(spark):
    ts = at("2024-01-06 10:00:00")
    rows = [(1, ts, 6, 10, 2.0, 1.0), (1, ts, 6, 10, 1.0, 9.0), (1, ts, 6, None, 1.0, 3.0),
            (1, ts, 6, 10, 1.0, 3.0), (None, ts, 6, 10, 4.0, 4.0), (None, ts, 6, 10, 4.0, 4.0)]
    kept = ops.dedup_observations(spark.createDataFrame(rows, OBSERVATION)).collect()
    assert sorted(map(tuple, kept), key=str) == sorted(
        [(1, ts, 6, None, 1.0, 3.0), (None, ts, 6, 10, 4.0, 4.0)], key=str
    )


def test_slot_bounds(observed):
    rows = observed(
        [(1, "2024-01-05 05:59:59", 1), (2, "2024-01-05 06:00:00", 1), (3, "2024-01-05 11:59:59", 1),
         (4, "2024-01-05 12:00:00", 1), (5, "2024-01-06 07:00:00", 1), (6, "2024-01-01 07:00:00", 1)]
    )
    kept = ops.filter_time_slot(rows, 1, 5, 6, 12)
    assert sorted(r.user_id for r in kept.collect()) == [2, 3, 6]


def test_off_network_rows_vanish(observed, line_network):
    rows = observed([(1, "2024-01-01 08:00:00", 1), (2, "2024-01-01 08:00:00", 7)])
    located = ops.locate_observations(rows, line_network.cells).collect()
    assert [(r.user_id, r.cell_id, r.cell_no) for r in located] == [(1, "A", 1)]


@pytest.mark.parametrize("partitions", [1, 7])
def test_cell_numbers_are_dense_in_id_order(spark, partitions):
    cells = spark.range(0, 500, 1, partitions).select(
        F.concat(F.lit("c"), F.col("id") * 7 % 500).alias("cell_id"),
        F.col("id").cast("double").alias("coord_x"),
        F.lit(0.0).alias("coord_y"),
    ).unionByName(
        spark.createDataFrame([(None, 1.0, 1.0)], "cell_id string, coord_x double, coord_y double")
    )
    rows = ops.number_cells(cells).collect()
    numbers = {r.cell_id: r.cell_no for r in rows}
    assert numbers.pop(None) is None
    assert [numbers[c] for c in sorted(numbers)] == list(range(1, 501))


def test_large_lookup_tables_join_without_broadcast(spark, monkeypatch):
    facts = spark.range(200).select((F.col("id") % 3).alias("k"), "id")
    table = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c")], "k bigint, v string")
    expected = sorted(map(tuple, ops.lookup_join(facts, table, ["k"]).collect()))
    monkeypatch.setattr(dimensions, "BROADCAST_ROWS", 1)
    joined = ops.lookup_join(facts, table, ["k"])
    assert "_salt" not in joined.columns
    assert sorted(map(tuple, joined.collect())) == expected
    assert len(expected) == 67 + 2 * 67
    for how, rows in (("left", 67 + 2 * 67 + 66), ("left_semi", 134)):
        assert ops.lookup_join(facts, table, ["k"], how).count() == rows
