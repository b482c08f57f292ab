"""The most frequent keys of a counted table, a set of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Classes of counts per doubling; at most 64 * this many rows reach the driver.
_STEPS = 8


def frequent(counted: DataFrame, limit: int, count: str = "n") -> DataFrame:
    """Rows of the highest counts, at most ``limit`` of them: all from the lowest
    class of counts that still fits."""
    level = F.floor(F.log2(F.col(count).cast("double")) * _STEPS)
    classes = counted.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()
    total, lowest = 0, None
    for row in classes:
        total += row["count"]
        if total > limit:
            break
        lowest = row["level"]
    return counted.filter(level >= lowest) if lowest is not None else counted.filter(F.lit(False))
