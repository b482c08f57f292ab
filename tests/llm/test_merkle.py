"""Merkle manifests against trees built one node at a time."""

import hashlib
import zlib

import pytest

from trackweave.llm.merkle import LEAF_COLUMNS, merkle_manifest, verified_documents

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_above(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [digest(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        levels.append(nodes)
    return levels


def proof(levels, place):
    for nodes in levels[:-1]:
        begin = place // 3 * 3
        yield nodes[begin:place], nodes[place + 1 : begin + 3]
        place //= 3


def brute(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    members = {
        s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        for s in sources
    }
    trees = {s: levels_above([leaf_of(r) for r in members[s]]) for s in sources}
    top = levels_above([trees[s][-1][0] for s in sources])
    root = top[-1][0]
    out = []
    for number, source in enumerate(sources):
        for place, row in enumerate(members[source]):
            way = [*proof(trees[source], place), *proof(top, number)]
            folded = leaf_of(row)
            if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                folded = leaf_of((*row[:4], row[4].replace("\n", "")))
            for left, right in way:
                folded = digest(*left, folded, *right)
            siblings = digest(*(d for left, right in way for d in left + right))
            out.append((row[0], leaf_of(row), trees[source][-1][0], root, siblings, folded, folded == root))
    return out


def order(row):
    return tuple((v is not None, v) if v is not None else (False, 0) for v in row)


def compare(frame):
    rows = [tuple(r) for r in frame.select(*LEAF_COLUMNS).collect()]
    got = [tuple(r) for r in verified_documents(frame).collect()]
    assert sorted(got, key=order) == sorted(brute(rows), key=order)
    return got


def test_documents_of_the_tables(spark):
    got = compare(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert {r[-1] for r in got} == {True, False}


def test_one_source_holds_most_rows(spark):
    rows = [(i, "hot" if i % 3 else f"s{i}", "en", i, f"a\n{i}") for i in range(300)]
    compare(spark.createDataFrame(rows, SCHEMA).repartition(16))


@pytest.mark.parametrize("count", [1, 2, 3, 4, 9, 10, 28])
def test_trees_of_few_leaves(spark, count):
    compare(spark.createDataFrame([(i, "only", None, None, "x\ny") for i in range(count)], SCHEMA))


def test_nulls_long_texts_and_repeated_rows(spark):
    rows = [
        (1, None, None, None, None),
        (1, None, None, None, None),
        (None, "a", "en", 0, ""),
        (None, "a", "en", 0, "\n"),
        (7, "ä", "en", 3, "é\n" * 60_000),
        (7, "ä", "en", 3, "other"),
        (8, "", "en", 3, "\n\n"),
        (9, "Z", None, -1, "1:x-"),
    ]
    compare(spark.createDataFrame(rows + rows[2:4], SCHEMA))


def test_other_columns_do_not_matter(spark):
    rows = [(i, "s", "en", 1, "t\n", "key", 3, b"x", True) for i in range(5)]
    compare(spark.createDataFrame(rows, SCHEMA + ", key string, tree long, leaf binary, verified boolean"))


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert verified_documents(empty).collect() == []
    manifest = merkle_manifest(empty)
    assert manifest.root is None and manifest.sources.count() == 0


def test_manifest_lists_sources(spark):
    rows = [(i, s, "en", 1, "t") for i, s in enumerate(["b", None, "a", "b"])]
    manifest = merkle_manifest(spark.createDataFrame(rows, SCHEMA))
    by_source = {s: sorted(leaf_of(r) for r in rows if r[1] == s) for s in (None, "a", "b")}
    listed = {r.source: (r.n_leaves, r.subroot) for r in manifest.sources.collect()}
    assert {s: n for s, (n, _) in listed.items()} == {None: 1, "a": 1, "b": 2}
    assert listed["a"][1] == by_source["a"][0]
    assert manifest.root == digest(listed[None][1], listed["a"][1], listed["b"][1])
