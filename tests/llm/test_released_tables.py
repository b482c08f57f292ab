"""Large tables of the near duplicates leave the disk when nothing reads them any more."""

import os

import pytest

pytest.importorskip("numpy")

from trackweave.llm import jaccard_join  # noqa: E402


def test_large_tables_are_removed_and_copies_found(spark, monkeypatch):
    stored, store = [], jaccard_join.store

    def watched(df):
        stored.append(store(df))
        return stored[-1]

    monkeypatch.setattr(jaccard_join, "store", watched)
    base = [f"w{i}" for i in range(40)]
    # Copies of one text, each with an end of its own; two ends are nearly alike.
    texts = [" ".join(base + [f"x{k}{i}" for i in range(9)]) for k in range(4)]
    texts += [" ".join(base), texts[3] + " y", "a text of its own"]
    rows = [(i, text) for i, text in enumerate(texts)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    kept = jaccard_join.keep_one_of_each(documents, words=2, percent=80)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 6]
    checked = [t for t in stored if "a_size" in t.columns]
    large = [t for t in stored if {"shingles", "key"} & set(t.columns) or {"prefix", "label"} <= set(t.columns)]
    # The pairs that are checked late are read by the components.
    large += checked[: -jaccard_join.BLOCKS]
    assert len(large) > 2 * jaccard_join.BLOCKS
    # A file list is kept by the table, so it tells what was there.
    files = [file for table in large for file in table.inputFiles()]
    assert files and not [f for f in files if os.path.exists(f.removeprefix("file://"))]
