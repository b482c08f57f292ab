"""Repair of the structure of conversations whose turns were lost, cut or repeated.

Faults are found with joins and aggregates, the cheapest repair of each conversation
by the branch and bound of ``turn_search``. Rows are partitioned by ranges of
(conversation, turn, role, begin of the text) and sorted, so a task reads a
conversation turn by turn. A conversation inside one partition is finished there. One
that may go on in the next partition, or that is longer than a piece, leaves pieces
instead: counts, the table of best paths through its turns, and its lines. The tables
of a conversation's pieces, which hold one character a turn, are then chained, every
piece gets its part of the audit, pieces are rendered in parallel, and only the
digest of a conversation's text, which cannot be split, runs over its pieces in one
task, in order and without holding them. So a conversation that holds a third of all
rows is spread over tasks, and rows equal in all columns are counted before the shuffle.

Edge cases: a null role or text is one space; a null turn comes before all others
and takes no part in gaps; a null conv_id is a conversation of its own; turns of equal
number are ordered by role and text, which are compared by their bytes, and repeated
rows are separate turns; an empty role has no initial, fits nothing and has to be changed
or deleted; texts of any length are read whole. Other columns are not read, whatever
their names. An empty table has no conversations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import store
from ..operators.dimensions import lookup_join
from .turn_search import LEGAL, NEXT, PUT, START, Trail, blocks, long_table, table

# Limits of a piece. They decide who does the work, not the result.
PIECE_TURNS = 10_000
PIECE_CHARACTERS = 8 << 20

_WHITE = " \t\n\x0b\x0c\r"
_CUT_END = re.compile(r"[.!?]\Z")
_NAMES = {"u": "user", "a": "assistant"}


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, n) after damage by the checksum of their place.

    ``n`` is how often the row stands there; a conversation that lost a row has a
    row of nulls with ``n`` 0, so that none disappears.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    place = F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")
    rows = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        shown("role").alias("role"),
        shown("text").alias("text"),
        (F.crc32(place) % 20).alias("kind"),
    )
    kind = F.col("kind")
    here = kind != 0
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return (
        rows.select(
            "conv_id",
            F.when(here, F.col("turn")).alias("turn"),
            F.when(here, F.when(kind == 4, "user").otherwise(F.col("role"))).alias("role"),
            F.when(here, text).alias("text"),
            F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
        )
        .groupBy("conv_id", "turn", "role", "text")
        .agg(F.sum("copies").alias("n"))
    )


def _message_key() -> Column:
    """One text per conversation, role and text."""
    parts = [F.coalesce(F.col("conv_id").cast("string"), F.lit("")), "role", "text"]
    sized = [F.concat_ws(":", F.length(p), p) for p in parts]
    return F.sha2(F.concat(F.col("conv_id").isNull().cast("string"), *sized), 256)


def with_repeats(rows: DataFrame) -> DataFrame:
    """Add ``again``: the conversation has the same message at an earlier turn.

    Only messages that stand at several turns are joined back.
    """
    keyed = rows.withColumn("message", _message_key())
    first, last = F.min(F.struct("turn")), F.max(F.struct("turn"))
    several = (
        keyed.filter("role IS NOT NULL")
        .groupBy("message")
        .agg(first.alias("first"), last.alias("last"))
        .filter("first != last")
        .select("message", F.col("first.turn").alias("first_turn"), F.lit(True).alias("several"))
    )
    joined = lookup_join(keyed, store(several), ["message"], "left")
    later = F.col("several").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first_turn"))
    return joined.select("conv_id", "turn", "role", "text", "n", later.alias("again"))


@dataclass
class Faults:
    """Counts over a stretch of turns, and what its neighbours need to know."""

    low: int | None = None
    high: int | None = None
    distinct: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first: str | None = None
    last: str | None = None

    def add(self, turn: int | None, initial: str, copies: int) -> None:
        if turn is not None:
            if self.low is None:
                self.low = turn
            self.distinct += turn != self.high
            self.high = turn
        if self.last is None:
            self.first = initial
        else:
            self.illegal += (self.last + initial) not in LEGAL
        # A role next to itself is never legal.
        self.illegal += copies - 1
        self.last = initial

    def join(self, after: Faults) -> None:
        """Take in the stretch that follows."""
        if after.low is not None:
            self.distinct += after.distinct - (after.low == self.high)
            self.low = after.low if self.low is None else self.low
            self.high = after.high
        self.blank += after.blank
        self.duplicate += after.duplicate
        self.truncated += after.truncated
        self.illegal += after.illegal
        if after.last is not None:
            if self.last is None:
                self.first = after.first
            else:
                self.illegal += (self.last + after.first) not in LEGAL
            self.last = after.last

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.distinct

    def shown(self) -> tuple[int, int, int, int, int]:
        return self.gaps(), self.blank, self.duplicate, self.truncated, self.illegal


class Stretch:
    """Turns of one conversation as a task reads them."""

    def __init__(self, conv_id: object) -> None:
        self.conv_id = conv_id
        self.faults = Faults()
        self.turns: list[str] = []
        self.count = 0
        self.characters = 0
        # (role, text, copies) of the turns.
        self.lines: list[tuple[str, str, int]] = []

    def add(self, turn: int | None, role: str, text: str, copies: int, again: bool) -> None:
        initial = role[:1]
        self.faults.add(turn, initial, copies)
        shown = text.strip(_WHITE)
        code = initial if initial in ("s", "u", "a") else "x"
        if not shown:
            self.faults.blank += copies
            code = "D"
        elif again:
            self.faults.duplicate += copies
            code = "D"
        else:
            self.faults.duplicate += copies - 1
            if not _CUT_END.search(shown):
                self.faults.truncated += 1
                code = code.upper()
        self.turns.append(code + "D" * (copies - 1))
        self.lines.append((role, text, copies))
        self.count += copies
        self.characters += len(role) + len(text) + 1

    def full(self, turns: int) -> bool:
        return self.count >= turns or self.characters >= PIECE_CHARACTERS


def rendered(lines: Iterable[tuple[str, str, int]], audit: str, state: int = START) -> list[str]:
    """The lines ``role:text`` that an audit leaves of turns that follow a state."""
    out: list[str] = []
    rows = (line for line in lines for _ in range(line[2]))
    for edit in audit:
        if edit == "I":
            put = PUT[state]
            out.append(_NAMES[put] + ":")
        else:
            role, text, _ = next(rows)
            if edit == "D":
                continue
            put = role[:1] if edit == "K" else PUT[state]
            out.append(f"{role if edit == 'K' else _NAMES[put]}:{text}")
        state = NEXT[state, put]
    return out


def digest(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def _solved(turns: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    trail = Trail()
    for block in blocks(turns):
        trail.extend(table(block))
    cost, parts = trail.result()
    return cost, "".join(audit for _, audit in parts)


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
_DONE = (*_COUNTS, "cost", "audit", "repaired_sha256")
_STATE = ("low", "high", "distinct", "blank", "duplicate", "truncated", "illegal", "first", "last")


def _arrow_done(conv_type: pa.DataType) -> list[pa.Field]:
    longs = [pa.field(c, pa.int64()) for c in (*_COUNTS, "cost")]
    return [pa.field("conv_id", conv_type), *longs, pa.field("audit", pa.string()), pa.field("repaired_sha256", pa.string())]


_PATHS = pa.list_(
    pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
)
_LINES = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("n", pa.int64())]))
_FAULTS = pa.struct(
    [(c, pa.string() if c in ("first", "last") else pa.int64()) for c in _STATE]
)
_DDL = {
    "paths": "array<struct<begin: int, end: int, cost: long, audit: string>>",
    "lines": "array<struct<role: string, text: string, n: long>>",
    "faults": "struct<" + ", ".join(f"{c}: {'string' if c in ('first', 'last') else 'long'}" for c in _STATE) + ">",
}


def _frames(rows: Iterable[tuple], schema: pa.Schema, limit: int = 2000, characters: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows with their size in front, in batches of bounded size."""
    held, size = [], 0

    def frame() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema
        )

    for weight, *row in rows:
        held.append(row)
        size += weight
        if len(held) >= limit or size >= characters:
            yield frame()
            held, size = [], 0
    if held:
        yield frame()


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _first_pass(conv_type: pa.DataType, piece_turns: int):
    """Finished conversations, and pieces of those at the ends of a partition."""
    schema = pa.schema(
        [
            *_arrow_done(conv_type),
            pa.field("part", pa.int32()),
            pa.field("piece", pa.int64()),
            pa.field("faults", _FAULTS),
            pa.field("paths", _PATHS),
            pa.field("lines", _LINES),
        ]
    )

    def finished(s: Stretch) -> tuple:
        cost, audit = _solved("".join(s.turns))
        return (
            len(audit), s.conv_id, *s.faults.shown(), cost, audit, digest(rendered(s.lines, audit)),
            None, None, None, None, None,
        )

    def piece(s: Stretch, part: int, number: int) -> tuple:
        paths = [(a, b, cost, audit) for (a, b), (cost, audit) in long_table("".join(s.turns)).items()]
        faults = {c: getattr(s.faults, c) for c in _STATE}
        empty = (None,) * len(_DONE)
        listed = [{"begin": a, "end": b, "cost": c, "audit": t} for a, b, c, t in paths]
        lines = [{"role": r, "text": t, "n": n} for r, t, n in s.lines]
        return (s.characters + 20 * s.count, s.conv_id, *empty, part, number, faults, listed, lines)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        current, number, in_pieces, part = None, 0, True, 0
        for part, conv_id, turn, role, text, n, again in _rows(batches):
            if current is None or conv_id != current.conv_id or current.full(piece_turns):
                if current is not None:
                    goes_on = conv_id == current.conv_id
                    if in_pieces or goes_on:
                        yield piece(current, part, number)
                        number += 1
                    else:
                        yield finished(current)
                    # What follows a piece of its own conversation is one as well.
                    in_pieces = goes_on
                current = Stretch(conv_id)
            if n:
                current.add(turn, role, text, n, again)
        if current is not None:
            yield piece(current, part, number)

    return schema, lambda batches: _frames(rows(batches), schema)


def _chain_pass(conv_type: pa.DataType):
    """For every conversation in pieces its cost, and per piece its part of the audit.

    The first row of a conversation carries the counts.
    """
    schema = pa.schema(
        [
            pa.field("conv_id", conv_type),
            pa.field("home_part", pa.int32()),
            pa.field("home_piece", pa.int64()),
            *[pa.field(c, pa.int64()) for c in (*_COUNTS, "cost")],
            pa.field("part", pa.int32()),
            pa.field("piece", pa.int64()),
            pa.field("state", pa.int32()),
            pa.field("audit", pa.string()),
        ]
    )

    def solved(conv_id: object, places: list, faults: Faults, trail: Trail) -> Iterator[tuple]:
        cost, parts = trail.result()
        counts = (*faults.shown(), cost)
        for place, (state, audit) in zip(places, parts):
            yield (len(audit) + 50, conv_id, *places[0], *counts, *place, state, audit)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        current = None
        for conv_id, part, piece, faults, paths in _rows(batches):
            if current is None or conv_id != current[0]:
                if current is not None:
                    yield from solved(*current)
                current = (conv_id, [], Faults(), Trail())
            current[1].append((part, piece))
            current[2].join(Faults(**faults))
            current[3].extend({(p["begin"], p["end"]): (p["cost"], p["audit"]) for p in paths})
        if current is not None:
            yield from solved(*current)

    return schema, lambda batches: _frames(rows(batches), schema)


def _render_pass():
    """The text that the audit leaves of a piece; null if it leaves no line."""
    schema = pa.schema(
        [("home_part", pa.int32()), ("home_piece", pa.int64()), ("part", pa.int32()), ("piece", pa.int64()), ("left", pa.string())]
    )

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i in range(batch.num_rows):
                *place, state, audit, lines = (column[i].as_py() for column in batch.columns)
                kept = rendered(((r["role"], r["text"], r["n"]) for r in lines), audit, state)
                left = "\n".join(kept) if kept else None
                yield (len(left or ""), *place, left)

    return schema, lambda batches: _frames(rows(batches), schema, limit=16)


def _digest_pass():
    """The digest of the texts of a conversation's pieces, taken in one after another."""
    schema = pa.schema([("home_part", pa.int32()), ("home_piece", pa.int64()), ("repaired_sha256", pa.string())])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        home, running, begun = None, None, False
        for batch in batches:
            for i in range(batch.num_rows):
                part, piece, _, _, left = (column[i].as_py() for column in batch.columns)
                if (part, piece) != home:
                    if home is not None:
                        yield (100, *home, running.hexdigest())
                    home, running, begun = (part, piece), hashlib.sha256(), False
                if left is not None:
                    if begun:
                        running.update(b"\n")
                    running.update(left.encode())
                    begun = True
        if home is not None:
            yield (100, *home, running.hexdigest())

    return schema, lambda batches: _frames(rows(batches), schema)


def _ddl(schema: pa.Schema, conv: str) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string"}
    return ", ".join(
        f"{f.name} {conv if f.name == 'conv_id' else _DDL.get(f.name) or kinds[f.type]}" for f in schema
    )


def repaired_conversations(conversations: DataFrame, piece_turns: int = PIECE_TURNS) -> DataFrame:
    """Per conversation the faults after damage and the cheapest repair."""
    conv = conversations.schema["conv_id"].dataType.simpleString()
    conv_type = pa.string() if conv == "string" else pa.int64()
    if conv != "string":
        conv = "long"
    rows = with_repeats(store(damaged(conversations.withColumn("conv_id", F.col("conv_id").cast(conv)))))
    ordered = (
        rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32))
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select(F.spark_partition_id().alias("part"), "conv_id", "turn", "role", "text", "n", "again")
    )
    schema, first = _first_pass(conv_type, piece_turns)
    passed = store(ordered.mapInArrow(first, _ddl(schema, conv)))
    done = passed.filter("part IS NULL").select("conv_id", *_DONE)

    pieces = passed.filter("part IS NOT NULL")
    schema, chain = _chain_pass(conv_type)
    slices = store(
        pieces.select("conv_id", "part", "piece", "faults", "paths")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "part", "piece")
        .mapInArrow(chain, _ddl(schema, conv))
    )
    schema, render = _render_pass()
    texts = (
        slices.select("home_part", "home_piece", "part", "piece", "state", "audit")
        .join(pieces.select("part", "piece", "lines"), ["part", "piece"])
        .select("home_part", "home_piece", "part", "piece", "state", "audit", "lines")
        .mapInArrow(render, _ddl(schema, conv))
    )
    schema, whole = _digest_pass()
    digests = (
        texts.repartition("home_part", "home_piece")
        .sortWithinPartitions("home_part", "home_piece", "part", "piece")
        .mapInArrow(whole, _ddl(schema, conv))
    )
    home = ["home_part", "home_piece"]
    audits = slices.groupBy("conv_id", *home, *_COUNTS, "cost").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "piece", "audit"))), lambda s: s["audit"]), "").alias("audit")
    )
    long_ones = audits.join(digests, home).select("conv_id", *_DONE)
    return done.unionByName(long_ones)
