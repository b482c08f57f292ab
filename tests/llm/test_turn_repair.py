"""Repair of conversations against a plain dynamic programme."""

import hashlib
import random
import re
import zlib

import pytest

from trackweave.llm import turn_search
from trackweave.llm.turn_repair import rendered, repaired_conversations

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"
FOLLOWS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def programme(turns):
    """Best (cost, audit) of turns written as in turn_search, state by state."""

    def offer(table, state, path):
        if state is not None and (state not in table or path < table[state]):
            table[state] = path
            return True
        return False

    def with_inserts(table):
        changed = True
        while changed:
            changed = False
            for state, (cost, audit) in list(table.items()):
                for role in "ua":
                    changed |= offer(table, FOLLOWS.get((state, role)), (cost + 3, audit + "I"))
        return table

    table = with_inserts({0: (0, "")})
    for turn in turns:
        after = {}
        for state, (cost, audit) in table.items():
            offer(after, state, (cost + 4, audit + "D"))
            if turn != "D":
                stays = cost + 3 * turn.isupper()
                offer(after, FOLLOWS.get((state, turn.lower())), (stays, audit + "K"))
                for role in "ua":
                    offer(after, FOLLOWS.get((state, role)), (stays + 3, audit + "R"))
        table = with_inserts(after)
    return min(table[s] for s in (0, 3) if s in table)


def brute(rows):
    """Every conversation on its own, from the definition."""
    conversations = {}
    for conv, turn, role, text in rows:
        place = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(place.encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        kept = conversations.setdefault(conv, [])
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        kept += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, kept in conversations.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, codes = set(), ""
        blank = duplicate = truncated = 0
        for _, role, text in kept:
            shown = text.strip(" \t\n\x0b\x0c\r")
            code = role[:1] if role[:1] in ("s", "u", "a") else "x"
            if not shown:
                blank, code = blank + 1, "D"
            elif (role, text) in seen:
                duplicate, code = duplicate + 1, "D"
            elif shown[-1] not in ".!?":
                truncated, code = truncated + 1, code.upper()
            seen.add((role, text))
            codes += code
        pairs = zip(kept, kept[1:])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs)
        turns = [r[0] for r in kept if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = programme(codes)
        lines, source, last = [], iter(kept), ""
        for edit in audit:
            role = "assistant" if last == "u" else "user"
            text = ""
            if edit != "I":
                _, own, text = next(source)
                if edit == "D":
                    continue
                role = own if edit == "K" else role
            lines.append(f"{role}:{text}")
            last = role[0]
        assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, blank, duplicate, truncated, illegal, cost, audit, digest))
    return out


def order(row):
    return row[0] is not None, row[0] or 0


def compare(frame, **options):
    rows = [tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()]
    got = repaired_conversations(frame, **options).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=order) == sorted(brute(rows), key=order)
    return got


@pytest.mark.parametrize("letters", ["suaxSUAXD", "ua", "uuuaD", "sssu", "UA", "uUaAD", "xX"])
def test_search_finds_the_best_repair(letters):
    chance = random.Random(letters)
    for _ in range(400):
        turns = "".join(chance.choice(letters) for _ in range(chance.randint(0, 14)))
        want = programme(turns)
        assert turn_search.search(turns) == want, turns
        assert turn_search.repair(turns, 3) == want, turns
        whole = turn_search.long_table(turns, 4)
        assert min(p for (a, b), p in whole.items() if a == 0 and b in (0, 3)) == want, turns


def test_bounds_never_exceed_the_cost():
    chance = random.Random(0)
    for _ in range(500):
        turns = "".join(chance.choice("suaxSUAXD") for _ in range(chance.randint(0, 9)))
        for state in turn_search.STATES:
            for place, bound in enumerate(turn_search.lower_bounds(turns)):
                best = turn_search.search(turns[place:], state, turn_search.STATES)
                assert bound <= best[0]


def test_long_sequences_in_blocks():
    chance = random.Random(4)
    turns = "".join(chance.choice("uauauaUAsD") for _ in range(3000))
    assert turn_search.repair(turns) == programme(turns)


def test_rendered_goes_on_from_a_state():
    lines = [("tool", "x", 1), ("user", "y", 2)]
    assert rendered(lines, "RKD", turn_search.USER) == ["assistant:x", "user:y"]
    assert rendered(lines, "IDIDKI", turn_search.START)[:2] == ["user:", "assistant:"]


def test_conversations_of_the_tables(spark):
    compare(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))


@pytest.fixture(scope="module")
def odd_rows():
    chance = random.Random(1)
    texts = ["Hi.", "Hi", "", "  \n", None, "a.b!", "x" * 50_000 + ".", "line\nother?", "Ende!\t"]
    rows = []
    for conv in [None, 1, 2, 3, 4, 5, 6] + [7] * 200 + [8] * 3:
        for turn in [None, 0, 1, 2, 3, 9] + ([chance.randint(0, 5000)] if conv == 7 else []):
            rows.append((conv, turn, chance.choice(["user", "assistant", "system", "tool", "", None, "Ü"]), chance.choice(texts)))
    return rows + rows[:40]


def test_nulls_ties_and_repeated_rows(spark, odd_rows):
    compare(spark.createDataFrame(odd_rows, SCHEMA).repartition(8))


@pytest.mark.parametrize("piece_turns", [1, 7])
def test_pieces_give_the_same(spark, odd_rows, piece_turns):
    compare(spark.createDataFrame(odd_rows, SCHEMA), piece_turns=piece_turns)


def test_other_columns_do_not_matter(spark):
    rows = [(0, i, r, "Hi.", 1, 2, "x") for i, r in enumerate(["user", "assistant", "user"])]
    frame = spark.createDataFrame(rows, SCHEMA + ", n long, part long, message string")
    assert len(compare(frame)) == 1


def test_dropped_and_empty_conversations(spark):
    gone = [(c, t, "user", "x.") for c in range(200) for t in (0,) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    assert gone
    rows = compare(spark.createDataFrame(gone, SCHEMA))
    empty = hashlib.sha256(b"").hexdigest()
    assert {tuple(r)[1:] for r in rows} == {(0, 0, 0, 0, 0, 0, "", empty)}
    assert compare(spark.createDataFrame([], SCHEMA)) == []
