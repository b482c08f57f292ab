"""Readers and writers on real files."""

from datetime import datetime

import pytest

from trackweave import operators as ops
from trackweave import sources

OBSERVATIONS = "uid;usage_dttm;tidenhnum;xtr10;ytr10\n"


def test_observations_from_a_glob(spark, tmp_path):
    (tmp_path / "a.csv").write_text(OBSERVATIONS + "8;2024-01-01 08:00:07;8;95;65\n")
    (tmp_path / "b.csv").write_text(OBSERVATIONS + "9;2024-01-07 23:59:59;;5;65.5\n")
    raw = sources.read_observations(spark, f"{tmp_path}/*")
    assert raw.schema == sources.OBSERVATION_FILE
    rows = ops.normalize_observations(raw).orderBy("user_id").collect()
    assert tuple(rows[0]) == (8, datetime(2024, 1, 1, 8, 0, 7), 1, 8, 95.0, 65.0)
    assert tuple(rows[1]) == (9, datetime(2024, 1, 7, 23, 59, 59), 7, None, 5.0, 65.5)


def test_cells_keep_their_id_as_text(spark, tmp_path):
    (tmp_path / "cells.csv").write_text("locid;xtr10;ytr10\n0069;95;65\n")
    raw = sources.read_cells(spark, str(tmp_path / "cells.csv"))
    assert [tuple(r) for r in ops.normalize_cells(raw).collect()] == [("0069", 95.0, 65.0)]


def test_ring_file_with_a_cell_without_neighbours(spark, tmp_path):
    text = "0 4 header\nA 1\nB\nX 0\n\nB 2\n A  C \nC 1\nB\n"
    (tmp_path / "ring1.txt").write_text(text)
    (tmp_path / "ring2.txt").write_text("0 4 header\nA 1\nC\nX 0\n\nB 0\n\nC 1\nA")
    paths = [str(tmp_path / "ring1.txt"), str(tmp_path / "ring2.txt")]
    records = {(r.ring_order, r.cell_id): (r.n, r.members) for r in
               sources.read_ring_records(spark, paths).collect()}
    assert records == {
        (1, "A"): (1, ["B"]), (1, "X"): (0, []), (1, "B"): (2, ["A", "C"]), (1, "C"): (1, ["B"]),
        (2, "A"): (1, ["C"]), (2, "X"): (0, []), (2, "B"): (0, []), (2, "C"): (1, ["A"]),
    }
    adjacency = sources.read_ring_adjacency(spark, paths)
    assert sorted(map(tuple, adjacency.collect())) == [
        ("A", "A", 0), ("A", "B", 1), ("A", "C", 2), ("B", "A", 1), ("B", "B", 0),
        ("B", "C", 1), ("C", "A", 2), ("C", "B", 1), ("C", "C", 0), ("X", "X", 0),
    ]


def test_lines_are_numbered_across_the_blocks_of_a_file(spark, tmp_path):
    lines = [f"line {k}" if k % 7 else "" for k in range(3000)]
    (tmp_path / "long.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "short.txt").write_text("only\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        numbered = sources.number_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 3
        rows = numbered.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    long = sorted((r.line_no, r.value) for r in rows if r.file.endswith("long.txt"))
    assert long == list(enumerate(lines))
    assert [(r.line_no, r.value) for r in rows if r.file.endswith("short.txt")] == [(0, "only")]


def test_matrix_round_trip_replaces_the_old_file(spark, tmp_path):
    path = str(tmp_path / "matrix")
    first = spark.createDataFrame([(1, 2, 0.1), (2, 1, 1 / 3)], "a int, b int, p double")
    for file_format in ("csv", "parquet"):
        sources.write_matrix(first, path + file_format, file_format)
        sources.write_matrix(first.filter("a = 2"), path + file_format, file_format)
        read = spark.read.format(file_format).schema(first.schema).option("header", True)
        assert [tuple(r) for r in read.load(path + file_format).collect()] == [(2, 1, 1 / 3)]


def test_columns_are_matched_by_name(spark, tmp_path):
    from pyspark.sql import types as T

    path = str(tmp_path / "by_name.csv")
    with open(path, "w") as file:
        file.write("usage_dttm;imei;uid;ytr10;tidenhnum;xtr10\n2024-01-01 08:00:07;x;ab12f;65;;95\n")
    text_ids = T.StructType([T.StructField("uid", T.StringType()), *sources.OBSERVATION_FILE.fields[1:]])
    row = sources.read_observations(spark, path, text_ids).first()
    assert (row.uid, row.xtr10, row.ytr10, row.tidenhnum) == ("ab12f", 95.0, 65.0, None)
    assert sources.read_observations(spark, path).first() == row
    with pytest.raises(Exception, match="uid is not bigint: ab12f"):
        sources.read_observations(spark, path, sources.OBSERVATION_FILE).collect()
    with pytest.raises(ValueError, match="no column locid"):
        sources.read_cells(spark, path)


def test_files_with_other_orders_of_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("locid;xtr10;ytr10\n1;2;3\n")
    (tmp_path / "b.csv").write_text("ytr10;xtr10;locid\n4;3;7\n")
    (tmp_path / "c.csv").write_text("more;ytr10;locid;xtr10\nx;6;8;5\n")
    (tmp_path / "empty.csv").write_text("")
    rows = sources.read_cells(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, rows)) == [("1", 2.0, 3.0), ("7", 3.0, 4.0), ("8", 5.0, 6.0)]
    (tmp_path / "d.csv").write_text("ytr10;locid\n4;7\n")
    with pytest.raises(ValueError, match="no column xtr10 in .*d.csv"):
        sources.read_cells(spark, str(tmp_path))


def test_one_hashed_id_makes_all_ids_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text(OBSERVATIONS + "8;2024-01-01 08:00:07;8;95;65\n")
    (tmp_path / "b.csv").write_text("uid;ytr10;xtr10;tidenhnum;usage_dttm\n;65;95;8;2024-01-01 08:00:07\nf1;65;95;8;2024-01-01 09:00:07\n")
    rows = sources.read_observations(spark, str(tmp_path)).collect()
    assert sorted((r.uid or "", r.xtr10, r.ytr10) for r in rows) == [("", 95.0, 65.0), ("8", 95.0, 65.0), ("f1", 95.0, 65.0)]


def test_large_files_have_their_header_in_the_first_block(spark, tmp_path):
    lines = "".join(f"{k};{k}.5;{-k}\n" for k in range(2000))
    (tmp_path / "a.csv").write_text("locid;xtr10;ytr10\n" + lines)
    (tmp_path / "b.csv").write_text("locid;ytr10;xtr10\n" + lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = sources.read_cells(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    straight = [(str(k), k + 0.5, float(-k)) for k in range(2000)]
    crossed = [(str(k), float(-k), k + 0.5) for k in range(2000)]
    assert sorted(map(tuple, rows)) == sorted(straight + crossed)


@pytest.mark.parametrize("record", ["A 3\nB", "A 0\nB", "A\nB", "A x\nB", "A 1\n"])
def test_counts_of_ring_records_are_checked(spark, tmp_path, record):
    (tmp_path / "ring.txt").write_text(f"header\n{record}\nC 1\nA\n")
    with pytest.raises(Exception, match="members do not match the record A"):
        sources.read_ring_adjacency(spark, [str(tmp_path / "ring.txt")]).collect()


def test_ring_files_of_several_blocks(spark, tmp_path):
    cells = [f"c{k}" for k in range(900)]
    text = "header\n" + "".join(
        f"{c} {k % 3}\n{' '.join(cells[k + 1 : k + 1 + k % 3])}\n" for k, c in enumerate(cells[:-3])
    )
    (tmp_path / "ring.txt").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        rows = sources.read_ring_adjacency(spark, [str(tmp_path / "ring.txt")]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [(c, c, 0) for c in cells[:-3]] + [
        (c, n, 1) for k, c in enumerate(cells[:-3]) for n in cells[k + 1 : k + 1 + k % 3]
    ]
    assert sorted(map(tuple, rows)) == sorted(want)
