"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def weekday_number(ts: str) -> Column:
    """1 for Monday through 7 for Sunday."""
    return F.weekday(ts) + F.lit(1)


def epoch_second(ts: str) -> Column:
    """Whole seconds since the epoch, rounded down."""
    return F.col(ts).cast("timestamp").cast("long")
