"""Set similarity join over word shingles by partition-and-enumerate signatures.

A document is the set of its distinct shingles. Two sets A, B with Jaccard
similarity of at least t differ in at most (1-t)/(1+t) * (|A|+|B|) elements.

Signatures. Set sizes fall into bands; a band with largest size r allows
k = 2r(1-t)/(1+t) differences. The feature domain is split by hash into
``first`` groups of ``SECOND`` partitions each, with ``first`` so large that
k differences leave some group with at most ``SECOND_ERRORS``. Every subset of
``SECOND - SECOND_ERRORS`` partitions of every group is enumerated; a set's
signature is the hash of its elements in the subset. So two similar sets share
at least one signature. A set writes signatures for its own band and for the
next one if a similar larger set may lie there.

Empty projections would be shared by everybody, so they are not written, and there
are partitions to spare for them: N partitions leave at least N - k on which two
similar sets agree. A set with as many empty ones is *thin*: it repeats the scheme with another split of the domain,
in a class of its own. A similar pair shares a projection that is not empty, or
both are thin and meet in the next level. The last level is one signature for
the whole class.

Links and components. No group of equal signatures is expanded into pairs:

1. every set is checked against one set (the leader) of each of its signatures,
   the one that meets most others;
2. confirmed links give components;
3. where a signature has more than two sets and a leader's sets are of several
   components, those that may still be similar are found by what they differ in
   from the leader (``late_pairs``), and checked.

A link left out joins two sets already in one component, so the components are
those of all links. Copies (equal sets) are one node throughout.

Edge cases: a null or empty text, or one without words, has an empty set and
links with nothing. Null ids take part, but never name a component: one of null
ids only has a null ``component_id``. Repeated ids are separate rows. Nodes are
64-bit fingerprints of sets; two given texts collide with probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import release, store
from . import hashing
from .columns import carries_other_columns
from .components import connected_components

# A subset is one partition of its group (SECOND - SECOND_ERRORS); ``thin`` counts on it.
SECOND, SECOND_ERRORS = 2, 1
LEVELS = 16
# A band's largest size over its smallest, as a power of 1/t.
BAND_POWER = 2
# Ids that are looked up by broadcast: at most this many (8 bytes each).
BROADCAST_IDS = 2_000_000

# Large joins of the near duplicates, at a low similarity, run in so many blocks, one after the other, so that only one of them
# has its shuffle files at a time. A block is a part of the keys, not of the rows.
BLOCKS = 6
# Times as many blocks for the late pairs, which spread sets by their elements.
LATE = 3

_KEY = "_text_key"
SETS = "doc_id long, text_key long, n_shingles long, node long"


def text_key():
    """Tells texts of one id apart."""
    return F.xxhash64("text", F.length("text")).alias("text_key")


def bands(largest: int, percent: int) -> np.ndarray:
    """Smallest size of each band up to the one that holds ``largest`` and the next."""
    starts = [1]
    while starts[-1] <= largest * 100 // percent + 1:
        end = int(starts[-1] * (100 / percent) ** BAND_POWER)
        starts.append(max(end, starts[-1]) + 1)
    starts.append(max(int(starts[-1] * (100 / percent) ** BAND_POWER), starts[-1]) + 1)
    return np.array(starts)


def _groups(errors: np.ndarray, smallest: np.ndarray) -> np.ndarray:
    """Groups for so many errors, with partitions to spare for those that stay empty
    in the smallest set of the band."""
    parts = errors + 1.0
    for _ in range(8):
        empty = parts * np.exp(-smallest / parts)
        parts = np.minimum(errors + 1 + empty + 3 * np.sqrt(empty), 4.0 * errors + 2)
    return np.ceil(parts / SECOND).astype(np.int64)


def signatures(
    values: np.ndarray, counts: np.ndarray, percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets given one after the other, and how many each set has."""
    n_sets = len(counts)
    filled = np.flatnonzero(counts > 0)
    if not len(filled):
        return np.empty(0, np.uint64), np.zeros(n_sets, np.int64)
    starts = bands(int(counts.max()), percent)
    own = np.searchsorted(starts, counts[filled], "right") - 1
    reach = np.searchsorted(starts, counts[filled] * 100 // percent, "right") - 1
    sets = np.concatenate([filled, filled[reach > own]])
    band = np.concatenate([own, reach[reach > own]])
    errors = 2 * (starts[band + 1] - 1) * (100 - percent) // (100 + percent)
    groups = _groups(errors, np.maximum(starts[band] * percent // 100, 1))
    first = np.cumsum(counts) - counts
    found, owners = [], []
    for level in range(LEVELS):
        parts = groups * SECOND
        base = np.cumsum(parts) - parts
        size = counts[sets]
        entry = np.repeat(np.arange(len(sets)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + first[sets][entry]
        scrambled = hashing.mix(values[at], 10 + level)
        slot = base[entry] + ((scrambled >> np.uint64(33)).astype(np.int64) % parts[entry])
        sums = np.zeros(parts.sum(), np.uint64)
        np.add.at(sums, slot, hashing.mix(scrambled, 5))
        members = np.bincount(slot, minlength=len(sums))
        sums, members = sums.reshape(-1, SECOND), members.reshape(-1, SECOND)
        group_entry = np.repeat(np.arange(len(sets)), groups)
        group = np.arange(len(sums)) - np.repeat(np.cumsum(groups) - groups, groups)
        empties = np.add.reduceat((members == 0).sum(axis=1), np.cumsum(groups) - groups)
        thin = empties >= parts - errors
        for number, subset in enumerate(combinations(range(SECOND), SECOND - SECOND_ERRORS)):
            picked = list(subset)
            label = ((band[group_entry] * 64 + level) * 64 + number) * (1 << 32) + group
            keys = hashing.mix(sums[:, picked].sum(axis=1) + hashing.mix(label, 6), 7)
            empty = members[:, picked].sum(axis=1) == 0
            found.append(keys[~empty])
            owners.append(sets[group_entry[~empty]])
        sets, band, errors, groups = sets[thin], band[thin], errors[thin], groups[thin]
        if not len(sets):
            break
    else:
        found.append(hashing.mix(band, 8))
        owners.append(sets)
    keys, owners = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return keys[order], np.bincount(owners, minlength=n_sets)


def _sets(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, words: int):
    starts, ends, texts = hashing.word_bounds(data, offsets)
    hashes = hashing.span_hashes(data, starts, ends)
    values, owners = hashing.shingles(hashes, texts, rows.num_rows, words)
    values, owners = hashing.distinct_per_text(values, owners)
    counts = np.bincount(owners, minlength=rows.num_rows)
    sums = np.zeros(rows.num_rows, np.uint64)
    np.add.at(sums, owners, hashing.mix(values, 9))
    nodes = hashing.mix(sums + counts.astype(np.uint64), 11).view(np.int64)
    return values, counts, nodes


def shingle_sets(documents: DataFrame, words: int) -> DataFrame:
    """Size and fingerprint of the set of every document."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in hashing.pieces(batches):
            _, counts, nodes = _sets(rows, data, offsets, words)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id").cast(pa.int64()),
                    rows.column("text_key"),
                    pa.array(counts.astype(np.int64)),
                    pa.array(nodes),
                ],
                names=["doc_id", "text_key", "n_shingles", "node"],
            )

    return documents.select("doc_id", text_key(), "text").mapInArrow(work, SETS)


def signature_rows(documents: DataFrame, words: int, percent: int) -> DataFrame:
    """node, key: every signature of every document. They are many, so they are made
    again where they are needed rather than stored."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in hashing.pieces(batches):
            values, counts, nodes = _sets(rows, data, offsets, words)
            keys, each = signatures(values, counts, percent)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(nodes, each)), pa.array(keys.view(np.int64))], names=["node", "key"]
            )

    return documents.select("text").mapInArrow(work, "node long, key long")


def node_shingles(documents: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """The shingles of wanted nodes (node, doc_id), from one text of each."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in hashing.pieces(batches):
            values, counts, nodes = _sets(rows, data, offsets, words)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes), hashing.ragged(values.view(np.int64), counts, pa.int64())],
                names=["node", "shingles"],
            )

    ids = wanted.select("doc_id").distinct()
    few = wanted.count() <= BROADCAST_IDS
    texts = documents.select("doc_id", "text").join(
        F.broadcast(ids) if few else ids, "doc_id", "left_semi"
    )
    nodes = wanted.select("node").distinct()
    return (
        texts.mapInArrow(work, "node long, shingles array<long>")
        .join(F.broadcast(nodes) if few else nodes, "node", "left_semi")
        .groupBy("node")
        .agg(F.first("shingles").alias("shingles"))
    )


def _differences(total, percent: int):
    """Most elements in which two similar sets of ``total`` elements together differ."""
    return F.floor(total * (100 - percent) / (100 + percent))


def union(tables: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _block_of(blocks: int, *columns: str):
    return F.pmod(F.xxhash64(*columns), F.lit(blocks))


def _block(number: int, blocks: int, *columns: str):
    return _block_of(blocks, *columns) == number


def checked_pairs(pairs: DataFrame, shingles: DataFrame, percent: int, blocks: int) -> DataFrame:
    """``confirmed`` of all pairs, stored."""
    return union(checked_blocks(pairs, shingles, percent, blocks))


def checked_blocks(pairs: DataFrame, shingles: DataFrame, percent: int, blocks: int) -> list[DataFrame]:
    """``confirmed`` of all pairs, a stored table for each block of b. A block moves the sets of its
    own pairs only; its leaders, if they are few, come to their sets."""
    leaders = store(pairs.select(_block_of(blocks, "b").alias("block"), F.col("a").alias("node")).distinct())
    most = leaders.groupBy("block").count().agg(F.max("count")).first()[0]

    def checked(i: int) -> DataFrame:
        own = leaders.filter(F.col("block") == i).select("node")
        left = shingles.join(F.broadcast(own) if (most or 0) <= BROADCAST_IDS else own, "node", "left_semi")
        right = shingles.filter(_block(i, blocks, "node"))
        return confirmed(pairs.filter(_block(i, blocks, "b")), left, right, percent)

    return [store(checked(i)) for i in range(blocks)]


def confirmed(pairs: DataFrame, left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with the exact sizes of their sets and of what they share.

    ``prefix`` holds the first elements in which b differs from a, those that a
    lacks before those that b lacks, each by value: as many as ``late_pairs`` needs,
    which is none if no signature of the pair has a third set. It has their upper
    halves only: elements that are equal meet there, others that do are checked later.
    """
    left = left.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = right.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    sized = pairs.join(left, "a").join(right, "b").select(
        "a",
        "b",
        "several",
        F.size("left").alias("a_size"),
        F.size("right").alias("b_size"),
        F.sort_array(F.array_except("right", "left")).alias("added"),
        F.sort_array(F.array_except("left", "right")).alias("removed"),
    )
    apart = F.size("added") + F.size("removed")
    both = F.col("a_size") + F.col("b_size")
    common = (both - apart) / 2
    linked = 100 * common >= percent * (both - common)
    near = apart - F.ceil((apart + (F.col("a_size") - F.col("b_size")) * (100 - percent) / (100 + percent)) / 2) + 2
    far = _differences(F.col("b_size") * (100 + percent) / percent, percent) + 2
    length = F.when(~F.col("several"), 0).when(linked, near).otherwise(F.greatest(near, far))
    prefix = F.slice(F.concat("added", "removed"), 1, F.greatest(length, F.lit(0)).cast("int"))
    return sized.select(
        "a",
        "b",
        "a_size",
        "b_size",
        apart.alias("apart"),
        linked.alias("linked"),
        F.transform(prefix, lambda x: F.shiftright(x, 32).cast("int")).alias("prefix"),
    )


def late_pairs(checked: list[DataFrame], labels: DataFrame, percent: int, blocks: int) -> DataFrame:
    """Pairs of sets with a common leader but of different components that may be
    similar.

    Relative to the leader a set is the elements in which it differs. Two sets
    differ in what is in one of these differences only, so similar ones must
    share a good part of them: (|Dx| + |Dy| - k) / 2, where one of the two is not
    similar to the leader and has a large difference. That many common elements
    put at least one into the prefixes of both, and only such pairs are made.
    Copies edited independently share few differences, so a large group of them
    makes few pairs.

    ``checked`` are the tables of blocks of b; each is removed when its sets are taken
    over, without prefixes being shuffled for labels and groups.
    """
    here = labels.select(F.col("node").alias("b"), F.col("label").alias("b_label"))
    there = labels.select(F.col("node").alias("a"), F.col("label").alias("a_label"))
    several = [part.filter(F.size("prefix") > 0) for part in checked]
    placed = store(
        union(several).select("a", "b").join(here, "b", "left").join(there, "a", "left").select(
            "a",
            "b",
            F.coalesce("b_label", "b").alias("label"),
            (F.coalesce("b_label", "b") != F.coalesce("a_label", "a")).alias("far"),
        )
    )
    open_ = placed.groupBy("a").agg(F.max("far").alias("any"), F.count("*").alias("n")).filter("any and n > 1")
    wanted = store(placed.join(open_.select("a"), "a", "left_semi"))
    release(placed)
    taken = []
    for i, (part, sets) in enumerate(zip(checked, several)):
        own = wanted.filter(_block(i, len(checked), "b"))
        taken.append(store(sets.select("a", "b", "b_size", "apart", "prefix").join(own, ["a", "b"])))
        release(part)
    release(wanted)
    members = union(taken)
    columns = ("a", "b", "b_size", "apart", "label", "far")

    def found(i: int) -> DataFrame:
        spread = members.select(*columns, F.posexplode("prefix").alias("at", "element")).filter(_block(i, blocks, "a", "element"))
        one = spread.drop("far")
        other = spread.filter("far").select(
            "a", "element", *(F.col(c).alias(f"y_{c}") for c in ("b", "b_size", "apart", "label", "at"))
        )
        allowed = _differences(F.col("b_size") + F.col("y_b_size"), percent)
        shared = F.ceil((F.col("apart") + F.col("y_apart") - allowed) / 2)
        return (
            one.join(other, ["a", "element"])
            .filter(
                (F.col("label") != F.col("y_label"))
                & (F.col("at") <= F.col("apart") - shared)
                & (F.col("y_at") <= F.col("y_apart") - shared)
            )
            .select(F.least("b", "y_b").alias("a"), F.greatest("b", "y_b").alias("b"))
            .distinct()
        )

    parts = [store(found(i)) for i in range(blocks)]
    every = store(union(parts).distinct().withColumn("several", F.lit(False)))
    for table in (*taken, *parts):
        release(table)
    return every


def jaccard_components(
    documents: DataFrame, words: int = 3, percent: int = 90, blocks: int = 1
) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (see the module)."""
    return labelled_rows(documents, words, percent, blocks).select("doc_id", "n_shingles", "component_id")


def labelled_rows(documents: DataFrame, words: int, percent: int, blocks: int) -> DataFrame:
    """Per document: doc_id, text_key, n_shingles, component_id, and the node that
    stands for its component, null without words."""
    sets = store(shingle_sets(documents, words))
    classes = store(
        sets.filter("n_shingles > 0")
        .groupBy("node")
        .agg(F.min("doc_id").alias("doc_id"))
    )
    keys = signature_rows(documents, words, percent)
    # Stored, so that the shuffle of the counts is gone before that of the join.
    shared = store(keys.groupBy("key").count().filter("count > 1").select("key"))
    crowded = store(keys.join(shared, "key").distinct())
    # The leader of a signature is the set that meets most others: in a group of
    # copies of one text that is the text itself, which all are similar to.
    met = crowded.groupBy("key").count()
    scores = crowded.join(met, "key").groupBy("node").agg(F.sum("count").alias("score"))
    leaders = crowded.join(scores, "node").groupBy("key").agg(
        F.max(F.struct("score", "node")).alias("top"), (F.count("*") > 2).alias("several")
    )
    pairs = store(
        crowded.join(leaders.select("key", "several", F.col("top.node").alias("leader")), "key")
        .filter("node != leader")
        .groupBy(F.col("leader").alias("a"), F.col("node").alias("b"))
        .agg(F.max("several").alias("several"))
    )
    release(shared)
    release(crowded)
    involved = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    # A node whose only texts have null ids is read by its null id.
    wanted = store(involved.join(classes, "node").select("node", "doc_id"))
    if wanted.filter("doc_id is null").limit(1).count():
        named, unnamed = wanted.filter("doc_id is not null"), documents.filter("doc_id is null")
        shingles = node_shingles(documents, named, words).union(
            node_shingles(unnamed.fillna({"doc_id": 0}), wanted.fillna({"doc_id": 0}), words)
        )
        shingles = store(shingles.groupBy("node").agg(F.first("shingles").alias("shingles")))
    else:
        shingles = store(node_shingles(documents, wanted, words))
    checked = checked_blocks(pairs, shingles, percent, blocks)
    release(pairs)
    links = store(union(checked).filter("linked").select("a", "b"))
    labels = connected_components(links)
    again = late_pairs(checked, labels, percent, blocks if blocks == 1 else LATE * blocks)
    late = checked_pairs(again, shingles, percent, blocks).filter("linked").select("a", "b")
    release(shingles)
    labels = connected_components(links.union(late))

    named = classes.join(labels, "node", "left").select(
        "node", "doc_id", F.coalesce("label", "node").alias("label")
    )
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    component = named.join(smallest, "label").select("node", "label", "component_id")
    found = sets.filter("n_shingles > 0").join(component, "node")
    empty = sets.filter("n_shingles = 0").withColumns({"component_id": F.col("doc_id"), "label": F.lit(None).cast("long")})
    columns = ["doc_id", "text_key", "n_shingles", "component_id", "label"]
    return found.select(columns).unionByName(empty.select(columns))


@carries_other_columns("doc_id", "text")
def keep_one_of_each(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, that of its smallest id and, of rows that share it,
    of the smallest text, with the columns as they came. Rows are told apart by id and
    text, so another text that shares an id with one that leaves is judged by its own
    component. Rows without words stay. Of the rows without an id one of each component
    stays too, that of the smallest text: it cannot be told whose copy it is."""
    found = store(labelled_rows(documents, words, percent, BLOCKS).filter("n_shingles > 0").drop("n_shingles"))
    # Only rows that leave, and those of which one has to be chosen, are joined.
    gone = store(found.filter("doc_id != component_id").select("doc_id", "text_key").distinct())
    first = found.filter("doc_id is null or doc_id = component_id")
    repeated = first.groupBy("label", "doc_id").count().filter("count > 1").drop("count")
    chosen = store(
        first.join(repeated, first["label"].eqNullSafe(repeated["label"]) & first["doc_id"].eqNullSafe(repeated["doc_id"]), "left_semi")
        .select("doc_id", "text_key", "label")
        .distinct()
    )
    keyed = documents.withColumn(_KEY, text_key())

    def same(other: DataFrame):
        return keyed["doc_id"].eqNullSafe(other["doc_id"]) & (keyed[_KEY] == other["text_key"])

    single = keyed.join(gone, same(gone), "left_anti").join(chosen, same(chosen), "left_anti")
    many = keyed.join(chosen, same(chosen)).select(
        chosen["doc_id"].alias("_id"), "label", keyed["text"].alias("_text"), F.struct(*(keyed[c] for c in documents.columns)).alias("_row")
    )
    one = many.groupBy("_id", "label").agg(F.min_by("_row", "_text").alias("_row"))
    return single.select(*documents.columns).unionByName(one.select("_row.*"))
