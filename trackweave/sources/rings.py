"""Ring files: line pairs of ``<cell> <count>`` and ``<member> <member> ...``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def number_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their position, as (file, line_no, value).

    Lines are numbered within each block a task reads and shifted by the lines
    of the earlier blocks, so no file has to pass through one task.
    """
    lines = (
        spark.read.text(path)
        .withColumn("file", F.col("_metadata.file_path"))
        .withColumn("_block", F.col("_metadata.file_block_start"))
        .withColumn("_order", F.monotonically_increasing_id())
    )
    earlier = (
        Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = (
        lines.groupBy("file", "_block")
        .agg(F.count("*").alias("_n"))
        .select("file", "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    )
    within = F.row_number().over(Window.partitionBy("file", "_block").orderBy("_order"))
    return (
        lines.withColumn("_within", within)
        .join(shifts, ["file", "_block"])
        .select("file", (F.col("_within") - 1 + F.col("_shift")).alias("line_no"), "value")
    )


def parse_ring_lines(lines: DataFrame) -> DataFrame:
    """Records (ring_order, cell_id, n, members) from (ring_order, file, line_no, value).

    Line 0 of a file is a header. Blank member lines stay in place, so a cell without
    neighbours does not shift the records after it. A record whose count is not the
    number of its members is an error when it is read.
    """
    body = lines.filter(F.col("line_no") > 0).select(
        "ring_order",
        "file",
        F.floor((F.col("line_no") - 1) / 2).alias("_record"),
        ((F.col("line_no") - 1) % 2).alias("_half"),
        F.trim("value").alias("_text"),
    )
    records = body.groupBy("ring_order", "file", "_record").agg(
        F.max(F.when(F.col("_half") == 0, F.col("_text"))).alias("_head"),
        F.max(F.when(F.col("_half") == 1, F.col("_text"))).alias("_tail"),
    )
    head = F.split("_head", r"\s+")
    listed = F.filter(F.split("_tail", r"\s+"), lambda m: m != "")
    members = F.coalesce(listed, F.array().cast("array<string>"))
    stated = F.try_element_at(head, F.lit(2)).try_cast("int")
    message = F.concat(
        F.lit("ring "), F.col("ring_order").cast("string"), F.lit(": members do not match the record "), "_head"
    )
    right = F.coalesce(stated == F.size(members), F.lit(False))
    return records.filter(F.col("_head") != "").select(
        "ring_order",
        head.getItem(0).alias("cell_id"),
        F.when(right, stated).otherwise(F.raise_error(message).cast("int")).alias("n"),
        F.when(right, members).otherwise(F.raise_error(message).cast("array<string>")).alias("members"),
    )


def read_ring_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of several ring files; the first path is ring 1, the next ring 2."""
    parts = [
        number_lines(spark, path).withColumn("ring_order", F.lit(order))
        for order, path in enumerate(paths, start=1)
    ]
    return parse_ring_lines(reduce(DataFrame.unionByName, parts))


def read_ring_adjacency(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Neighbours (cell_id, neighbor_id, ring_order); order 0 is the cell itself."""
    return adjacency_from_records(read_ring_records(spark, paths))


def adjacency_from_records(records: DataFrame) -> DataFrame:
    """One row per cell and neighbour, plus one order-0 row per cell."""
    own = (
        records.select("cell_id")
        .distinct()
        .select("cell_id", F.col("cell_id").alias("neighbor_id"), F.lit(0).alias("ring_order"))
    )
    others = records.select(
        "cell_id", F.explode("members").alias("neighbor_id"), F.col("ring_order").cast("int")
    )
    return own.unionByName(others)
