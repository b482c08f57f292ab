"""Personal data: patterns propose spans, checksums confirm them, context adjusts.

Each kind has a pattern. Its matches are located in code points and validated
(octets of an address, Luhn for cards, digit counts for phones, mod-97 for bank
accounts). A kind has a starting score; a context word of the kind near the span
adds to it. A span is reported from ``ACCEPT`` on. Base kinds start there, so
context never removes them; ``secret`` and ``local_phone`` need context.

Patterns are linear in the text: runs are possessive and start only where a run
starts, or where the last match ended. A kind runs only over texts with the
characters it needs, which is a plain scan.

Edge cases: a null or empty text has no spans. Spans of one kind never overlap,
those of different kinds may; ``mask`` merges overlapping ones. Added kinds give
way to base spans they overlap. Rows are independent, so repeated rows, empty
tables and extra columns need no care.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import carries_other_columns, let, matches, without

ACCEPT = 0.5
CONTEXT_BONUS = 0.3
# Characters before and after a span in which context words count.
CONTEXT_BEFORE, CONTEXT_AFTER = 48, 16
_SPANS = "array<struct<start:int,end:int,found:string>>"


def _always(found: Column) -> Column:
    return F.lit(True)


def octets(found: Column) -> Column:
    """Every part of a dotted number is at most 255."""

    def small(part: Column) -> Column:
        plain = F.regexp_replace(part, "^0+(?=[0-9])", "")
        return F.when(F.length(plain) <= 3, plain.cast("int") <= 255).otherwise(False)

    return F.forall(F.split(found, r"\."), small)


def luhn(found: Column) -> Column:
    """13 to 19 digits whose Luhn sum is a multiple of ten."""

    def holds(digits: Column) -> Column:
        def digit(i: Column) -> Column:  # i counts from the right, from 1
            d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
            return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

        places = F.sequence(F.lit(1), F.length(digits))
        total = F.aggregate(places, F.lit(0), lambda s, i: s + digit(i))
        return F.when(F.length(digits).between(13, 19), total % 10 == 0).otherwise(False)

    return let(without(found, " -"), holds)


def phone_digits(found: Column) -> Column:
    return F.length(F.regexp_replace(found, "[^0-9]", "")).between(9, 15)


def mod97(found: Column) -> Column:
    """Account numbers: first four characters last, letters as 10 to 35, remainder 1."""

    def holds(compact: Column) -> Column:
        turned = F.concat(F.substring(compact, 5, 34), F.substring(compact, 1, 4))

        def step(rest: Column, c: Column) -> Column:
            letter = F.ascii(c) - 55
            return F.when(F.ascii(c) >= 65, (rest * 100 + letter) % 97).otherwise((rest * 10 + F.ascii(c) - 48) % 97)

        remainder = F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(step(r, c)))
        return F.when(F.length(compact).between(15, 34), remainder == 1).otherwise(False)

    return let(without(found, " "), holds)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str  # a pattern that every text with a match matches, cheap to look for
    valid: Callable[[Column], Column] = _always
    score: float = ACCEPT
    context: tuple[str, ...] = field(default=())


# The patterns of the four base kinds are fixed values (written possessively).
_MAIL = "[A-Za-z0-9._%+-]"
BASE = (
    Kind(
        "email",
        rf"(?:\G|(?<!{_MAIL})){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@",
        score=0.7,
        context=("mail", "contact", "write"),
    ),
    Kind(
        "ip",
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"[0-9]\.[0-9]",
        octets,
        context=("ip", "address", "server", "host"),
    ),
    Kind(
        "card",
        r"[0-9](?:[ -]?[0-9])++",
        r"[0-9](?:[ -]?[0-9]){12}",
        luhn,
        score=0.6,
        context=("card", "visa", "credit", "payment"),
    ),
    Kind("phone", r"\+[0-9][ ().0-9-]+(?<=[0-9])", r"\+[0-9]", phone_digits, context=("phone", "tel", "call", "mobile")),
)
ADDED = (
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        "[A-Z]{2}[0-9]{2}",
        mod97,
        score=0.8,
        context=("iban", "account", "bank"),
    ),
    Kind(
        "secret",
        r"(?<![A-Za-z0-9])[0-9a-f]{32,64}(?![A-Za-z0-9])",
        "[0-9a-f]{32}",
        score=0.3,
        context=("token", "secret", "password", "key"),
    ),
    Kind(
        "local_phone",
        r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
        "[0-9]{3}[ .-][0-9]{4}",
        score=0.3,
        context=("phone", "tel", "call", "mobile"),
    ),
)


def _scored(text: Column, kind: Kind, order: int) -> Column:
    """Valid spans of a kind: (kind_no, start, end, kind, score)."""
    gate = F.contains(text, F.lit("@")) if kind.needs == "@" else text.rlike(kind.needs)
    words = "|".join(kind.context)
    near = rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{words})"

    def scored(m: Column) -> Column:
        low = F.greatest(m["start"] - CONTEXT_BEFORE, F.lit(0))
        before = F.substring(text, low + 1, m["start"] - low)
        after = F.substring(text, m["end"] + 1, F.lit(CONTEXT_AFTER))
        bonus = F.when(F.concat(before, F.lit(" "), after).rlike(near), CONTEXT_BONUS).otherwise(0.0)
        return F.struct(
            F.lit(order).alias("kind_no"),
            m["start"].alias("start"),
            m["end"].alias("end"),
            F.lit(kind.name).alias("kind"),
            (F.lit(kind.score) + bonus).alias("score"),
        )

    valid = F.filter(matches(text, kind.pattern), lambda m: kind.valid(m["found"]))
    spans = F.filter(F.transform(valid, scored), lambda s: s["score"] >= ACCEPT)
    none = F.array().cast("array<struct<kind_no:int,start:int,end:int,kind:string,score:double>>")
    return F.coalesce(F.when(gate, spans), none)


def with_spans(rows: DataFrame, text: str, base: str, added: str) -> DataFrame:
    """rows with two columns of spans: those of the base kinds, and the others."""
    found = F.concat(*(_scored(F.col(text), kind, n) for n, kind in enumerate(BASE)))
    extra = F.concat(*(_scored(F.col(text), kind, len(BASE) + n) for n, kind in enumerate(ADDED)))
    clear = lambda s: ~F.exists(
        F.col(base), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])
    )
    return rows.withColumn(base, found).withColumn(added, F.filter(extra, clear))


def _listed(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def personal_data(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, counts and digest of the base spans, all spans as text, n_added."""
    rows = with_spans(documents.select("doc_id", "text"), "text", "_base", "_added")

    def number(name: str) -> Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")

    counts = [number(kind.name) for kind in BASE]
    return rows.select(
        "doc_id",
        *counts,
        F.sha2(_listed(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.concat("_base", "_added")).alias("spans"),
        F.size("_added").cast("long").alias("n_added"),
    )


@carries_other_columns("text")
def mask(documents: DataFrame) -> DataFrame:
    """documents with every span in ``text`` replaced by its kind in angle brackets;
    overlapping spans become one, named after the first."""
    rows = with_spans(documents, "text", "_base", "_added")
    ordered = F.sort_array(
        F.transform(
            F.concat("_base", "_added"),
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
        )
    )
    rows = rows.withColumn("_base", ordered).drop("_added")

    def take(seen: Column, span: Column) -> Column:
        """Append the text since the last span and the mark; or lengthen the last span."""
        fresh = span["start"] >= seen["upto"]
        gap = F.substring(F.col("text"), seen["upto"] + 1, span["start"] - seen["upto"])
        return F.struct(
            F.when(fresh, F.concat(seen["out"], gap, F.lit("<"), F.upper(span["kind"]), F.lit(">")))
            .otherwise(seen["out"])
            .alias("out"),
            F.greatest(seen["upto"], span["end"]).alias("upto"),
        )

    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("upto"))
    end = lambda seen: F.concat(seen["out"], F.substring(F.col("text"), seen["upto"] + 1, F.length("text")))
    masked = F.when(F.size("_base") > 0, F.aggregate("_base", begin, take, end)).otherwise(F.col("text"))
    return rows.withColumn("text", masked).select(*documents.columns)
