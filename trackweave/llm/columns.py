"""Column expressions shared by the native operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Separators of the word pattern [^\x20\x09-\x0D]+, as a regular expression and as text.
WHITE_RUN = r"[\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"
_CHUNK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once and not again inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def white_words(text: Column) -> Column:
    """Words between white space; none for a null text."""
    pieces = F.array_remove(F.split(text, WHITE_RUN), "")
    return F.coalesce(pieces, F.array().cast("array<string>"))


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def neighbours(values: Column, step: int, combine: Callable[[Column, Column], Column]) -> Column:
    """``combine`` of every element and the one ``step`` further on."""
    count = F.greatest(F.size(values) - step, F.lit(0))
    return F.zip_with(F.slice(values, F.lit(1), count), F.slice(values, F.lit(step + 1), count), combine)


def running_total(values: Column) -> Column:
    """Sums of the elements up to and with each one, in chunks so that long arrays
    stay affordable."""

    def extend(first: Column, part: Column) -> Column:
        return F.aggregate(
            part, F.array(first), lambda seen, x: F.concat(seen, F.array(F.element_at(seen, -1) + x))
        )

    def whole(v: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _CHUNK).cast("int"))
        part = lambda c: F.slice(v, c * _CHUNK + 1, F.lit(_CHUNK))
        sums = F.transform(chunks, lambda c: F.aggregate(part(c), F.lit(0), lambda s, x: s + x))
        return let(
            extend(F.lit(0), sums),
            lambda offsets: F.flatten(
                F.transform(chunks, lambda c: F.slice(extend(F.get(offsets, c), part(c)), F.lit(2), F.lit(_CHUNK)))
            ),
        )

    return let(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(F.array().cast("array<int>")))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: (start, end, found), in code points from 0."""

    def located(m: Column) -> Column:
        widths = F.transform(m["found"], lambda f, i: F.length(f) + F.length(F.get(m["gaps"], i)))
        return let(
            running_total(widths),
            lambda ends: F.transform(
                m["found"],
                lambda f, i: F.struct(
                    (F.get(ends, i) - F.length(f)).alias("start"), F.get(ends, i).alias("end"), f.alias("found")
                ),
            ),
        )

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(
        F.struct(found.alias("found"), F.split(text, pattern, -1).alias("gaps")), located
    )


def free_name(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column has it, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


_CARRIED = "_carried_columns"


def carries_other_columns(*needed: str) -> Callable:
    """For functions that keep or change rows of documents: all columns but the
    ``needed`` ones travel in one struct, so that no name of theirs can meet a name
    that the function uses, and come back with their values and in their places."""

    def decorate(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(function)
        def run(documents: DataFrame, *args, **options) -> DataFrame:
            others = [c for c in documents.columns if c not in needed]
            if not others:
                return function(documents, *args, **options)
            quoted = {c: f"`{c.replace('`', '``')}`" for c in documents.columns}
            packed = documents.select(*needed, F.struct(*(F.col(quoted[c]) for c in others)).alias(_CARRIED))
            done = function(packed, *args, **options)
            return done.select(
                *(F.col(c) if c in needed else F.col(f"{_CARRIED}.{quoted[c]}").alias(c) for c in documents.columns)
            )

        return run

    return decorate
