"""Cheapest repair of a sequence of turns, by depth-first branch and bound.

A turn is one character: the initial ``s``, ``u`` or ``a`` of its role, ``x`` for any
other, in capitals if its text is cut short, or ``D`` if it has to go. Edits are
Keep, Rerole (to user or assistant), Delete and Insert (a user or an assistant turn);
the result has to read ``(s?(ua)+)?``. Among the cheapest repairs the one with the
least audit, the initials of its edits in order, is wanted.

A repair is a path through four states (nothing yet, after a system, a user, an
assistant turn). An audit tells the cost of its turns, so of two paths between the same
states with equal cost neither audit begins the other, and the better of two prefixes
stays the better one whatever follows. That makes the dominance tables exact, and lets
long conversations be solved in blocks: a block's table has the best path for
every pair of states at its ends, and tables are joined in order.
"""

from __future__ import annotations

from collections.abc import Iterable

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
# States in which a conversation may end.
FINAL = (START, ASSISTANT)
# The costs of the edits.
REROLE, DELETE, INSERT, CUT_SHORT = 3, 4, 3, 3
# Turns of a block; longer conversations are solved in several. A search may visit a
# turn again for every better beginning, so blocks are short.
BLOCK = 12

# Where a role leads from a state.
NEXT = {
    (START, "s"): SYSTEM,
    (START, "u"): USER,
    (SYSTEM, "u"): USER,
    (USER, "a"): ASSISTANT,
    (ASSISTANT, "u"): USER,
}
LEGAL = {"su", "ua", "au"}
# The only role that may be put after a state.
PUT = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}

Path = tuple[int, str]


def lower_bounds(turns: str) -> list[int]:
    """The least cost of the turns from each place on.

    A turn cut short costs 3 at least, one that has to go 4. Two turns next to each
    other that cannot both stay as they are cost more: 1 if deleting one of them
    saves what it costs anyway, else 3. Pairs that share no turn are added up.
    """
    count = len(turns)
    least = [DELETE if t == "D" else CUT_SHORT if t.isupper() else 0 for t in turns]
    staying = [i for i, t in enumerate(turns) if t != "D"]
    after = dict(zip(staying, staying[1:]))
    bounds = [0] * (count + 1)
    # paired[i]: the same, if the turn that stays next is part of no pair yet.
    for i in range(count - 1, -1, -1):
        bounds[i] = least[i] + bounds[i + 1]
        j = after.get(i)
        if j is not None and (turns[i] + turns[j]).lower() not in LEGAL:
            extra = DELETE - CUT_SHORT if turns[i].isupper() or turns[j].isupper() else REROLE
            between = DELETE * (j - i - 1)
            bounds[i] = max(bounds[i], least[i] + between + least[j] + extra + bounds[j + 1])
    return bounds


def search(turns: str, entry: int = START, goals: tuple[int, ...] = FINAL) -> Path | None:
    """The best (cost, audit) from ``entry`` to one of ``goals``, or None."""
    bounds, count = lower_bounds(turns), len(turns)
    incumbent: Path | None = None
    best: dict[tuple[int, int], Path] = {}
    stack = [(0, "", 0, entry)]
    while stack:
        cost, audit, at, state = stack.pop()
        if incumbent is not None:
            reach = cost + bounds[at]
            if reach > incumbent[0] or (reach == incumbent[0] and audit > incumbent[1][: len(audit)]):
                continue
        known = best.get((at, state))
        if known is not None and known <= (cost, audit):
            continue
        best[at, state] = (cost, audit)
        if at == count and state in goals and (incumbent is None or (cost, audit) < incumbent):
            incumbent = (cost, audit)
        put = PUT[state]
        following = [(cost + INSERT, audit + "I", at, NEXT[state, put])]
        if at < count:
            turn = turns[at]
            following.append((cost + DELETE, audit + "D", at + 1, state))
            if turn != "D":
                stays = cost + (CUT_SHORT if turn.isupper() else 0)
                kept = NEXT.get((state, turn.lower()))
                if kept is not None:
                    following.append((stays, audit + "K", at + 1, kept))
                following.append((stays + REROLE, audit + "R", at + 1, NEXT[state, put]))
        # The most promising comes off the stack first.
        following.sort(key=lambda node: (node[0] + bounds[node[2]], node[1]), reverse=True)
        stack.extend(following)
    return incumbent


def table(turns: str) -> "Table":
    """The best path through a block for every pair of states that has one."""
    paths = {(a, b): search(turns, a, (b,)) for a in STATES for b in STATES if b != START or a == START}
    return {ends: path for ends, path in paths.items() if path is not None}


Table = dict[tuple[int, int], Path]


def joined(first: Table, second: Table) -> Table:
    """The table of two stretches of turns, one after the other."""
    paths: Table = {}
    for (begin, middle), (cost, audit) in first.items():
        for end in STATES:
            more = second.get((middle, end))
            if more is not None:
                path = (cost + more[0], audit + more[1])
                if (begin, end) not in paths or path < paths[begin, end]:
                    paths[begin, end] = path
    return paths


def long_table(turns: str, size: int = BLOCK) -> Table:
    """The table of any number of turns. Tables of like length are joined, so that
    an audit is copied as often as its length can be doubled."""
    stack: list[tuple[int, Table]] = []
    for block in blocks(turns, size):
        weight, paths = 1, table(block)
        while stack and stack[-1][0] <= weight:
            before, left = stack.pop()
            weight, paths = weight + before, joined(left, paths)
        stack.append((weight, paths))
    whole = None
    for _, left in reversed(stack):
        whole = left if whole is None else joined(left, whole)
    return table("") if whole is None else whole


class Trail:
    """The best way to every state after some blocks, block by block.

    The ways share their common beginnings; two of equal cost are compared from the
    place where they part.
    """

    def __init__(self) -> None:
        # state -> (cost, way); a way is (way before, state before, audit of the block).
        self.ways: dict[int, tuple[int, tuple | None]] = {START: (0, None)}

    def extend(self, paths: Table) -> None:
        ways: dict[int, tuple[int, tuple | None]] = {}
        for (begin, end), (cost, audit) in paths.items():
            if begin not in self.ways:
                continue
            before, way = self.ways[begin]
            new = (before + cost, (way, begin, audit))
            if end not in ways or new[0] < ways[end][0] or (new[0] == ways[end][0] and _less(new[1], ways[end][1])):
                ways[end] = new
        self.ways = ways

    def result(self) -> tuple[int, list[tuple[int, str]]]:
        """The cost, and per block the state in front of it and its audit."""
        chosen = None
        for state in FINAL:
            if state in self.ways:
                cost, way = self.ways[state]
                if chosen is None or cost < chosen[0] or (cost == chosen[0] and _less(way, chosen[1])):
                    chosen = (cost, way)
        cost, way = chosen
        parts = []
        while way is not None:
            way, state, audit = way
            parts.append((state, audit))
        return cost, parts[::-1]


def _less(a: tuple | None, b: tuple | None) -> bool:
    """Whether the audit of way ``a`` comes before that of ``b``, of as many blocks."""
    left, right = [], []
    while a is not b:
        left.append(a[2])
        right.append(b[2])
        a, b = a[0], b[0]
    return "".join(reversed(left)) < "".join(reversed(right))


def blocks(turns: str, size: int = BLOCK) -> Iterable[str]:
    return (turns[i : i + size] for i in range(0, len(turns), size))


def repair(turns: str, size: int = BLOCK) -> Path:
    """The best (cost, audit) of a whole conversation."""
    if len(turns) <= size:
        return search(turns)
    trail = Trail()
    for block in blocks(turns, size):
        trail.extend(table(block))
    cost, parts = trail.result()
    return cost, "".join(audit for _, audit in parts)
