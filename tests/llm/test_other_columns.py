"""Functions on documents with columns named like their own."""

import pytest
from pyspark.sql import functions as F

from trackweave.llm.decontaminate import drop_contaminated
from trackweave.llm.jaccard_join import keep_one_of_each
from trackweave.llm.pii import mask
from trackweave.llm.quality_rules import keep_good

NAMES = [
    "label", "LABEL2", "_id", "_key", "_h", "_rate", "_seen", "_words", "_lines", "_text_key", "_base",
    "_added", "node", "copies", "text_key", "component_id", "n_shingles", "quality", "_host", "a.b", "_row",
]
WORDS = "the quick brown fox jumps over a lazy dog while seven small birds watch from one old tree near water"
TEXTS = [
    f"{WORDS} first. Write to me@example.org now.",
    f"{WORDS} first. Write to me@example.org now.",
    "short",
    None,
    "other words entirely that nobody else uses in this small table of texts about rain and snow and hail and wind",
]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, text, "host", "en", len(text or "")) for i, text in enumerate(TEXTS)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    return frame.select("*", *(F.concat(F.lit(f"{name} "), "doc_id").alias(name) for name in NAMES))


def rows_of(frame):
    return {r["doc_id"]: r for r in frame.collect()}


@pytest.mark.parametrize("function", [keep_good, keep_one_of_each, drop_contaminated, mask])
def test_columns_come_back_with_their_values(spark, documents, function):
    more = [spark.createDataFrame([(1, TEXTS[-1])], "item_id long, text string")] if function is drop_contaminated else []
    got = function(documents, *more)
    plain = function(documents.select("doc_id", "text", "source", "lang", "n_chars"), *more)
    assert got.columns == documents.columns
    rows = rows_of(got)
    assert sorted(rows) == sorted(rows_of(plain)) and rows
    for i, row in rows.items():
        assert [row[name] for name in NAMES] == [f"{name} {i}" for name in NAMES]
        assert row["n_chars"] == len(TEXTS[i] or "") and row["lang"] == "en"
        assert row["text"] == rows_of(plain)[i]["text"]
