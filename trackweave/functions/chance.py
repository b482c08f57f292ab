"""Reproducible random numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*parts: str | int, seed: int = 0) -> Column:
    """A number in (0, 1) that depends on the given columns and the seed only.

    ``parts`` are column names or whole numbers. A retried task draws the same
    number again, which a per-partition generator does not promise. It is one
    parsed expression because loops build it at every step.
    """
    text = ", ".join(str(part) for part in (*parts, seed))
    bits = f"conv(substring(md5(concat_ws('|', {text})), 1, 8), 16, 10)"
    return F.expr(f"(CAST({bits} AS BIGINT) + 0.5D) / 4294967296D")
