"""Lookup tables with a known size, and joins that respect it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..settings import BROADCAST_ROWS, SALTS


@dataclass(frozen=True)
class Dimension:
    """A lookup table and its counted rows; the entries of lists count as rows."""

    df: DataFrame
    rows: int

    @property
    def fits_broadcast(self) -> bool:
        return self.rows <= BROADCAST_ROWS

    def joinable(self) -> DataFrame:
        """The table with the join that its counted rows allow, whatever the size of its file."""
        return F.broadcast(self.df) if self.fits_broadcast else by_shuffle(self.df)


def measure(table: DataFrame | Dimension) -> Dimension:
    """Count a lookup table, unless that was done before."""
    if isinstance(table, Dimension):
        return table
    lists = [f.name for f in table.schema if isinstance(f.dataType, T.ArrayType)]
    if not lists:
        return Dimension(table, table.count())
    entries = sum((F.greatest(F.size(c), F.lit(1)) for c in lists), F.lit(0))
    return Dimension(table, table.agg(F.coalesce(F.sum(entries), F.lit(0))).first()[0])


def lookup_join(
    facts: DataFrame, table: DataFrame | Dimension, on: list[str], how: str = "inner"
) -> DataFrame:
    """Join a large table with a lookup table on equal columns.

    A small lookup table is broadcast, so the large side never moves. A larger
    one is copied ``SALTS`` times and met by rows spread over the salts, so that
    one frequent key is shared by several tasks. The hint keeps Spark, which takes
    the copies for one row, from collecting and broadcasting all of them.
    """
    table = measure(table)
    if table.fits_broadcast:
        return facts.join(F.broadcast(table.df), on, how)
    spread = F.pmod(F.xxhash64(*facts.columns), F.lit(SALTS)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return (
        facts.withColumn("_salt", spread)
        .join(table.df.withColumn("_salt", copies).hint("merge"), [*on, "_salt"], how)
        .drop("_salt")
    )


def by_shuffle(table: DataFrame) -> DataFrame:
    """Keep Spark from broadcasting a table of many rows because its file is small."""
    return table.hint("merge")


def join_null_safe(
    left: DataFrame, right: DataFrame, keys: list[str], how: str
) -> DataFrame:
    """Equi-join that also matches null with null, keeping the left key columns."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys],
    )
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])
