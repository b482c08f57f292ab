"""Matrices as rows (from, to, weight, prob)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import outer_product
from ..lineage import store
from ..settings import LINKS_PER_BLOCK
from .dimensions import Dimension, lookup_join, measure


def explode_updates(pairs: DataFrame, origin: str, destination: str) -> DataFrame:
    """One row (from_cell, to_cell, weight) per combination of two states."""
    return pairs.select(F.inline(outer_product(origin, destination)))


def collect_pairs(
    updates: DataFrame,
    origin: str = "from_cell",
    destination: str = "to_cell",
    within: tuple[str, ...] = (),
) -> DataFrame:
    """Total weight per (from, to)."""
    return updates.groupBy(*within, origin, destination).agg(F.sum("weight").alias("weight"))


def count_pairs(
    pairs: DataFrame,
    origin: str,
    destination: str,
    names: tuple[str, str] = ("from_no", "to_no"),
    within: tuple[str, ...] = (),
) -> DataFrame:
    """(from_no, to_no, weight) where the weight is the number of pairs.

    ``names`` are the names of the ends, ``within`` further columns to count by.
    """
    ends = [F.col(origin).alias(names[0]), F.col(destination).alias(names[1])]
    return pairs.groupBy(*within, *ends).agg(F.count("*").cast("double").alias("weight"))


def _spread(
    counts: DataFrame, links: Dimension, cell: str, link: str, ends: tuple[str, str], within: tuple[str, ...]
) -> DataFrame:
    """Both ends of counted pairs spread over the links of their cells, one after the other."""
    if not links.fits_broadcast:
        return _spread_in_blocks(counts, links, cell, link, ends, within)
    first, second = ends
    origins = Dimension(links.df.withColumnRenamed(cell, first), links.rows)
    destinations = Dimension(links.df.withColumnRenamed(cell, second), links.rows)
    product = (F.col("weight") * F.col("prop")).alias("weight")
    from_spread = lookup_join(counts, origins, [first]).select(
        *within, F.col(link).alias(first), second, product
    )
    summed = collect_pairs(from_spread.repartition(*within, first), first, second, within)
    both = lookup_join(summed, destinations, [second]).select(
        *within, first, F.col(link).alias(second), product
    )
    return collect_pairs(both, first, second, within)


def _spread_in_blocks(
    counts: DataFrame, links: Dimension, cell: str, link: str, ends: tuple[str, str], within: tuple[str, ...]
) -> DataFrame:
    """The same with links that are too many to broadcast.

    Cells are dealt to blocks, ranges of their keys. While one end is spread, pairs lie
    by the block of the other end and the cell that is spread: each such group is a row
    and meets the links of its cell, also one row, so neither products nor copies of
    the links per pair are shuffled. Sums stay within their block. Cells with near keys
    are often neighbours and share a block; where they are not, a block meets more links.
    """
    first, second = ends
    blocks = 1 + links.rows // LINKS_PER_BLOCK
    ranges = links.df.select(cell).distinct().repartitionByRange(blocks, cell)
    placed = store(ranges.select(cell, F.spark_partition_id().alias("_block")))
    home = placed.withColumnsRenamed({cell: link, "_block": "_at"}).hint("merge")
    unlisted = F.pmod(F.xxhash64(link), F.lit(blocks)).cast("int")
    entry = F.struct(link, F.coalesce("_at", unlisted).alias("_at"), "prop")
    packed = store(
        links.df.join(home, link, "left").groupBy(cell).agg(F.collect_list(entry).alias("_links"))
    )

    def spread(rows: DataFrame, end: str, other: str) -> DataFrame:
        listed = F.collect_list(F.struct(other, "weight")).alias("_ends")
        met = (
            rows.groupBy(*within, "_block", end)
            .agg(listed)
            .join(packed.withColumnRenamed(cell, end).hint("merge"), end)
            .repartition(blocks, "_block")
        )
        pairs = met.select(*within, "_block", "_links", F.inline("_ends")).select(
            *within, "_block", other, "weight", F.inline("_links")
        )
        total = F.sum(F.col("weight") * F.col("prop")).alias("weight")
        return pairs.groupBy(*within, "_block", F.col(link).alias(end), "_at", other).agg(total)

    by_second = counts.join(placed.withColumnRenamed(cell, second).hint("merge"), second)
    by_first = spread(by_second, first, second).drop("_block").withColumnRenamed("_at", "_block")
    return spread(by_first, second, first).select(*within, first, second, "weight")


def spread_pairs(
    counts: DataFrame, links: DataFrame | Dimension, within: tuple[str, ...] = ()
) -> DataFrame:
    """Spread counted pairs over the ring distributions of both ends.

    The state of a row depends on its cell only, so pairs are counted by cell
    first and spread afterwards: origins, sum, destinations, sum. No step meets
    the product of two rings per pair, and its size follows the network, not
    the number of observations. Partitioned by origin once, both sums and a
    later normalisation stay within their partitions.
    """
    return _spread(counts, measure(links), "cell_no", "link_no", ("from_no", "to_no"), within)


def spread_pairs_by_id(counts: DataFrame, distribution: DataFrame | Dimension) -> DataFrame:
    """The same on cell ids, before cells are numbered: (from_cell, to_cell, weight)
    from counts with these names and a distribution (cell_id, neighbor_id, prop)."""
    return _spread(
        counts, measure(distribution), "cell_id", "neighbor_id", ("from_cell", "to_cell"), ()
    )


def _both_ends(matrix: DataFrame, cells: Dimension, key: str, ends: tuple[str, str], names) -> DataFrame:
    for end, renamed in zip(ends, names):
        table = cells.df.select(
            F.col(key).alias(end), *[F.col(c).alias(new) for c, new in renamed.items()]
        )
        matrix = lookup_join(matrix, Dimension(table, cells.rows), [end])
    return matrix


def simplify_matrix_ids(matrix: DataFrame, cells: DataFrame | Dimension) -> DataFrame:
    """Replace cell ids by cell numbers; pairs with an unknown cell vanish."""
    return _both_ends(
        matrix,
        measure(cells),
        "cell_id",
        ("from_cell", "to_cell"),
        ({"cell_no": "from_no"}, {"cell_no": "to_no"}),
    ).select("from_no", "to_no", "weight")


def row_normalize(matrix: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Add ``prob``: the weight divided by the total of its origin."""
    row = Window.partitionBy(*within, "from_no")
    return matrix.withColumn("prob", F.col("weight") / F.sum("weight").over(row))


def gis_export(matrix: DataFrame, cells: DataFrame | Dimension) -> DataFrame:
    """Probability with the original id and coordinates of both ends."""
    return _both_ends(
        matrix,
        measure(cells),
        "cell_no",
        ("from_no", "to_no"),
        (
            {"cell_id": "from_cell", "coord_x": "from_x", "coord_y": "from_y"},
            {"cell_id": "to_cell", "coord_x": "to_x", "coord_y": "to_y"},
        ),
    ).select("prob", "from_cell", "from_x", "from_y", "to_cell", "to_x", "to_y")


def matrix_coo(matrix: DataFrame) -> DataFrame:
    """The coordinate triples (from_no, to_no, prob)."""
    return matrix.select("from_no", "to_no", "prob")
