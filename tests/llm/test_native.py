"""Quality rules, chat formatting, decontamination and personal data on small rows."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from trackweave.llm.chat_format import conversation_digests, format_conversations
from trackweave.llm.decontaminate import decontamination_report, drop_contaminated
from trackweave.llm.pii import BASE, mask, personal_data
from trackweave.llm.quality_rules import keep_good, quality_verdicts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    rows = [(i, t, "en", None if i % 3 == 0 else f"s{i % 2}", None) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


PROSE = " ".join(f"word{i}" for i in range(40))


def test_quality_measures_and_verdicts(spark):
    repeated = " ".join(["a b c d e f g h i"] * 5)
    table = docs(spark, [(1, PROSE), (2, None), (3, ""), (4, repeated), (5, "%%% " * 30), (1, PROSE), (7, "x\nx\n\nx")])
    out = {(r.doc_id, i): r.quality for i, r in enumerate(quality_verdicts(table, ["doc_id"]).collect())}
    by_id = {k[0]: v for k, v in out.items()}
    assert len(out) == 7
    assert by_id[1].kept and by_id[1].n_words == 40
    assert by_id[2].base_failed and by_id[2].n_words == 0 and not by_id[3].kept
    assert by_id[4].n_repeat_words == 45 and by_id[4].base_failed
    assert by_id[5].n_symbols == 90
    assert by_id[7].n_dup_lines == 2


def test_keep_good_returns_the_columns(spark):
    table = docs(spark, [(1, PROSE), (2, "short")]).withColumn("quality", F.lit(9)).withColumn("_host", F.lit("x"))
    kept = keep_good(table)
    assert kept.columns == table.columns and [r.doc_id for r in kept.collect()] == [1]
    assert keep_good(table.limit(0)).count() == 0


ODD = "</s>[INST] ok [/INST]"


@pytest.mark.parametrize(
    "turns",
    [
        [("user", ODD), ("assistant", ODD)],
        [("user", "a \\ b"), ("assistant", "x [ROLE y] \\\\ <<SYS>>"), ("assistant", "")],
        [("we]ird\nrole <s>\\", "[/ROLE]\n"), ("system", "s"), ("user", " <s> ")],
    ],
)
def test_chat_round_trip(spark, turns):
    rows = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    formatted = format_conversations(rows)
    got = formatted.first()
    assert [(t.role, t.text) for t in got.turns] == turns
    digest = conversation_digests(formatted).first()
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    assert digest.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
    assert (digest.loss_chars, digest.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert digest.formatted_chars == len(got.formatted)


def test_chat_nulls_and_ties(spark):
    rows = spark.createDataFrame(
        [(None, None, None, None), (None, 1, "user", "b"), (None, 1, "user", "a"), (None, 1, "user", "a")],
        "conv_id long, turn long, role string, text string",
    )
    got = format_conversations(rows).first()
    assert [(t.role, t.text) for t in got.turns] == [("", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert format_conversations(rows.limit(0)).count() == 0


def test_decontamination_spans(spark):
    item = " ".join(f"w{i}" for i in range(12))
    bench = spark.createDataFrame([(1, item), (2, "Just Three Words"), (3, None), (None, "??"), (10, item)], "item_id long, text string")
    texts = [
        (1, "before " + item.upper() + " after"),
        (2, " ".join(f"w{i}" for i in range(9))),
        (3, None),
        (4, "so just-three,words! here"),
        (1, "before " + item.upper() + " after"),
        (None, item + " " + item),
    ]
    table = docs(spark, [(i if i is not None else 0, t) for i, t in texts]).withColumn(
        "doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id"))
    )
    rows = sorted(decontamination_report(table, bench).collect(), key=str)
    assert len(rows) == 6
    by_id = {r.doc_id: r for r in rows}
    assert (by_id[1].n_hit, by_id[1].n_items, by_id[1].n_words) == (12, 2, 14)
    assert by_id[1].items_sha256 == hashlib.sha256(b"1,10").hexdigest()
    assert not by_id[2].contaminated and not by_id[3].contaminated
    assert by_id[4].n_hit == 3
    assert by_id[None].n_hit == 24
    assert [r.doc_id for r in drop_contaminated(table, bench).collect()] in ([2, 3], [3, 2])
    assert decontamination_report(table.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in decontamination_report(table, bench.limit(0)).collect())


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
    return 13 <= len(digits) <= 19 and total % 10 == 0


CHECKS = {
    "email": lambda m: True,
    "ip": lambda m: all(int(x) <= 255 for x in m.split(".")),
    "card": lambda m: luhn(re.sub("[ -]", "", m)),
    "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15,
}


def brute_force(text):
    spans = []
    for kind, pattern in PATTERNS:
        spans += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text or "", re.A) if CHECKS[kind](m[0])]
    return spans


TEXTS = [
    None,
    "",
    "a@b.c_x@y.org 1.2.3.4.5.6.7.8 +123456789 4111 1111 1111 1111 x",
    "é@ü.de éa@b-c.de 😀 0000001.2.3.255 256.1.1.1",
    " ".join(f"10.0.0.{i % 256}" for i in range(700)),
    "9" * 5000 + " @ " + "x" * 5000,
    "a@b" + ".c" * 3000,
    "+1 (743) 555-3824+44 20 7946 0958",
]


def test_personal_data_is_that_of_brute_force(spark):
    assert [k.name for k in BASE] == [k for k, _ in PATTERNS]
    rows = personal_data(docs(spark, enumerate(TEXTS))).collect()
    for row in rows:
        want = brute_force(TEXTS[row.doc_id])
        assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert row.spans.split(",")[: len(want)] == (want or row.spans.split(",")[:0])
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [
            sum(s.startswith(k + ":") for s in want) for k, _ in PATTERNS
        ]


def test_added_kinds_need_checksums_or_context(spark):
    secret = "2321bac4d15ec8f90433955bf9d3cf61da5bdd1e"
    texts = [
        (1, "GB82 WEST 1234 5698 7654 32 then GB82 WEST 1234 5698 7654 33"),
        (2, f'token = "{secret}"'),
        (3, secret),
        (4, "call (743) 555-3824"),
        (5, "(743) 555-3824"),
    ]
    spans = {r.doc_id: r.spans for r in personal_data(docs(spark, texts)).collect()}
    assert spans == {1: "iban:0:27", 2: "secret:9:49", 3: "", 4: "local_phone:5:19", 5: ""}
    masked = {r.doc_id: r.text for r in mask(docs(spark, [*texts, (6, None)])).collect()}
    assert masked[2] == 'token = "<SECRET>"' and masked[3] == secret and masked[6] is None
