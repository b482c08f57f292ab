"""Chat formatting with a grammar round trip.

A conversation is rendered turn by turn as ``OPEN text CLOSE`` and a line break:

    [INST] question [/INST]
    <s> answer </s>
    <<SYS>> instruction <</SYS>>
    [ROLE name] text [/ROLE]          any other role

The parser is deterministic: it cuts before every opening string, and a piece is
a turn only if it is one opening, a text without control strings, and the
closing string of the same role. Rendered text is parsed again and compared with
the source. A turn that does not come back as it was is rendered escaped (a
backslash behind the opening string says so): backslashes are doubled, and one
goes into every control string. If the whole still differs, every turn is
escaped. Escaped text holds no control string, so that attempt always succeeds.

The loss mask is the list of spans, in code points of the rendered text, that
hold assistant texts.

Edge cases: turns are ordered by turn, then role, then text, so ties have one
result and repeated rows stay. A null turn comes first. Null text and null role
are empty; an empty role is one of the other roles. Rows with a null id are one
conversation. A conversation is one row and so has to fit into one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let, running_total

# The control strings of the template.
ROLES = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER_OPEN, OTHER_CLOSE = "[ROLE ", "[/ROLE]"
_CONTROL = r"</?s>|\[/?INST\]|<</?SYS>>|\[ROLE |\[/ROLE\]"
_CONTROL_REST = r"/?s>|/?INST\]|</?SYS>>|ROLE |/ROLE\]"
_OPENING = r"(?=\[INST\]|<s>|<<SYS>>|\[ROLE )"
_HEAD = r"(?s)^(\[INST\]|<s>|<<SYS>>|\[ROLE (?:\\.|[^\]\\])*+\])(\\?) "


def escape(text: Column) -> Column:
    """Double backslashes and break control strings with one."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, rf"([<\[])(?={_CONTROL_REST})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _opening(role: Column) -> Column:
    named = F.concat(F.lit(OTHER_OPEN), F.regexp_replace(escape(role), r"\]", r"\\]"), F.lit("]"))
    out = named
    for name, (open_, _) in ROLES.items():
        out = F.when(role == name, F.lit(open_)).otherwise(out)
    return out


def _closing(role: Column) -> Column:
    out = F.lit(OTHER_CLOSE)
    for name, (_, close) in ROLES.items():
        out = F.when(role == name, F.lit(close)).otherwise(out)
    return out


def render(role: Column, text: Column, escaped: bool) -> Column:
    mark = F.lit("\\ " if escaped else " ")
    body = escape(text) if escaped else text
    return F.concat(_opening(role), mark, body, F.lit(" "), _closing(role), F.lit("\n"))


def parse_turn(piece: Column) -> Column:
    """(role, text, start, end, escaped) of a piece; start and end are those of the
    rendered text in the piece. Null if the piece is no turn."""

    def opened(head: Column) -> Column:
        open_ = F.regexp_extract(piece, _HEAD, 1)
        role = unescape(F.substring(open_, F.lit(len(OTHER_OPEN) + 1), F.length(open_) - len(OTHER_OPEN) - 1))
        for name, (fixed, _) in ROLES.items():
            role = F.when(open_ == fixed, F.lit(name)).otherwise(role)
        return let(role, lambda r: closed(head, r))

    def closed(head: Column, role: Column) -> Column:
        tail = F.concat(F.lit(" "), _closing(role), F.lit("\n"))
        length = F.length(piece) - F.length(head) - F.length(tail)
        body = F.substring(piece, F.length(head) + 1, length)
        escaped = F.substring(head, -2, 1) == "\\"
        turn = F.struct(
            role.alias("role"),
            F.when(escaped, unescape(body)).otherwise(body).alias("text"),
            F.length(head).alias("start"),
            (F.length(head) + length).alias("end"),
            escaped.alias("escaped"),
        )
        fits = (length >= 0) & F.endswith(piece, tail)
        return F.when(fits & ~body.rlike(_CONTROL), turn)

    head = F.regexp_extract(piece, _HEAD, 0)
    return let(head, lambda h: F.when(h != "", opened(h)))


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation, in order; a piece that is none is null."""

    def located(pieces: Column) -> Column:
        ends = running_total(F.transform(pieces, lambda p: F.length(p)))
        return let(
            ends,
            lambda upto: F.transform(
                pieces,
                lambda p, i: let(
                    F.struct((F.get(upto, i) - F.length(p)).alias("at"), parse_turn(p).alias("turn")),
                    lambda t: F.when(
                        t["turn"].isNotNull(),
                        F.struct(
                            t["turn"]["role"].alias("role"),
                            t["turn"]["text"].alias("text"),
                            (t["at"] + t["turn"]["start"]).alias("start"),
                            (t["at"] + t["turn"]["end"]).alias("end"),
                            t["turn"]["escaped"].alias("escaped"),
                        ),
                    ),
                ),
            ),
        )

    return let(F.filter(F.split(formatted, _OPENING, -1), lambda p: p != ""), located)


def _same(turns: Column, source: Column) -> Column:
    """The parsed turns are those of the source."""
    pair = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    return F.coalesce(F.transform(turns, pair) == F.transform(source, pair), F.lit(False))


def format_conversations(rows: DataFrame) -> DataFrame:
    """Per conversation: conv_id, formatted, turns (parsed from it), loss_spans."""
    empty = F.lit("")
    turn = F.struct(
        "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("source"))

    def careful(t: Column) -> Column:
        """The plain form if it parses back to the turn, else the escaped one."""
        plain = render(t["role"], t["text"], False)
        back = let(
            parse(plain),
            lambda p: (F.size(p) == 1) & (F.get(p, F.lit(0))["role"] == t["role"]) & (F.get(p, F.lit(0))["text"] == t["text"]),
        )
        return F.when(F.coalesce(back, F.lit(False)), plain).otherwise(render(t["role"], t["text"], True))

    attempts = (
        lambda t: render(t["role"], t["text"], False),
        careful,
        lambda t: render(t["role"], t["text"], True),
    )
    done = grouped.withColumn("formatted", F.lit(None).cast("string")).withColumn(
        "turns", F.lit(None).cast("array<struct<role:string,text:string,start:int,end:int,escaped:boolean>>")
    )
    for attempt in attempts:
        settled = _same(F.col("turns"), F.col("source"))
        again = F.array_join(F.transform("source", attempt), "")
        done = done.withColumn("formatted", F.when(settled, F.col("formatted")).otherwise(again))
        done = done.withColumn("turns", F.when(settled, F.col("turns")).otherwise(parse(F.col("formatted"))))
    mask = F.transform(
        F.filter("turns", lambda t: t["role"] == "assistant"),
        lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["escaped"].alias("escaped")),
    )
    return done.select("conv_id", "formatted", "turns", mask.alias("loss_spans"))


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests, all read back from the rendered text."""
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))

    def masked(span: Column) -> Column:
        part = F.substring(F.col("formatted"), span["start"] + 1, span["end"] - span["start"])
        return F.when(span["escaped"], unescape(part)).otherwise(part)

    with_loss = formatted.withColumn("loss", F.array_join(F.transform("loss_spans", masked), ""))
    return with_loss.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
