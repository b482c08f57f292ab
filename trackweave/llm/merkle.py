"""Merkle manifest of a data set: a tree per source, a tree over sources, and proofs.

A leaf is the hash of a document's columns. Three consecutive nodes (at the end of a
level fewer, even one) hash to a node of the next level until one is left, the
source's subroot; the subroots, ordered by source, make the root the same way.

Proofs are found by pointer jumping. Every node starts with a link to its parent and
the segment of siblings on the way. A round joins the links with themselves on the
node they lead to, which doubles their distance and concatenates their segments, so
that after log2(height) rounds the link of every leaf leads to the root. A node of a
source's tree serves only the rounds that its level divides, so a round's second
side shrinks as the hot upper nodes gather more links.

Leaves are numbered inside range partitions of (source, doc_id, leaf) and shifted by
the counts of the partitions before, so a source that holds a third of all rows is
spread over tasks. Nothing is broadcast by hint; the driver sees the root, the size
of the largest source and the number of sources. Links are stored tables.

Edge cases: a null column is hashed as ``-``, an empty text as ``0:``; a null source
is a source of its own, before all others; null doc_ids come first in their source
and are never tampered with; rows of one doc_id are ordered by their leaf, so repeated
rows are separate leaves with the same hash. Texts of any length are hashed whole.
Other columns are not read, whatever their names. An empty table has no rows, no
sources and a null root.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import store

FAN = 3
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
# The tree over the sources; theirs are numbered from 0.
UPPER = -1
# The place in a proof where it leaves the tree of the source.
BORDER = "|"
# Nodes in a file of a level, at least; a number of files, not of rows.
NODES_PER_FILE = 100_000
_BYTES = 32
_NODE = ["tree", "level", "idx"]
_UP = [f"up_{c}" for c in _NODE]


@dataclass(frozen=True)
class Manifest:
    """``root`` in hexadecimal; ``sources`` with (source, n_leaves, subroot); ``proofs``
    with (doc_id, leaf, changed, siblings, shape), a row per document.

    ``siblings`` are the digests of a proof from the leaf to the root, ``shape`` has
    a character per level: place + 3 * (members - 1), or ``BORDER``. ``changed`` is
    the leaf after tampering, null where it is the same.
    """

    root: str | None
    sources: DataFrame
    proofs: DataFrame


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(text: Column | None = None) -> Column:
    """Hexadecimal hash of a document's columns, with another ``text`` if given."""
    parts = [encoded(F.col(c)) for c in LEAF_COLUMNS[:-1]]
    return F.sha2(F.concat(*parts, encoded(F.col(LEAF_COLUMNS[-1]) if text is None else text)), 256)


def tampered_hash() -> Column:
    """The leaf after line feeds were deleted from the documents with an even
    checksum of their doc_id; null for the others."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(chosen, leaf_hash(F.replace("text", F.lit("\n"), F.lit(""))))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _numbered(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with (tree, idx, n), and the sources as (key, tree, n)."""
    ranged = store(
        leaves.repartitionByRange("key", "doc_id", "hash")
        .sortWithinPartitions("key", "doc_id", "hash", "changed")
        .withColumn("place", F.monotonically_increasing_id())
    ).withColumn("part", F.shiftright("place", 33))
    # As many rows as there are sources and partitions.
    parts = store(
        ranged.groupBy("key", "part").agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    )
    sources = parts.groupBy("key").agg(
        F.min("part").alias("part"), F.min("first").alias("first"), F.sum("rows").alias("n")
    )
    # A row per partition: the sources that begin in the partitions before it.
    shifts = (
        sources.groupBy("part")
        .agg(F.count("*").alias("begun"))
        .withColumn(
            "shift",
            F.coalesce(
                F.sum("begun").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .drop("begun")
    )
    within = F.row_number().over(Window.partitionBy("part").orderBy("first")) - 1
    sources = store(
        sources.withColumn("within", within)
        .join(shifts, "part")
        .select("key", (F.col("shift") + F.col("within")).alias("tree"), "n")
    )
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn(
        "offset", F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first")
    ).join(sources, "key")
    placed = ranged.join(offsets.select("key", "part", "offset", "tree", "n"), ["key", "part"])
    return placed.select("tree", (F.col("offset") + F.col("place")).alias("idx"), "n", "hash", "doc_id", "changed"), sources


def _links(nodes: DataFrame, level: int, files: int) -> tuple[DataFrame, DataFrame]:
    """Links of the nodes of one level to their parents, and the parents.

    ``files`` bounds the files of the stored groups: upper levels are small."""
    carried = [c for c in ("doc_id", "changed") if c in nodes.columns]
    groups = store(
        nodes.filter("n > 1")
        .groupBy("tree", F.expr(f"idx div {FAN}").alias("up"), "n")
        .agg(F.array_sort(F.collect_list(F.struct("idx", "hash", *carried))).alias("members"))
        .coalesce(files)
    )
    digest = F.sha2(F.array_join(F.transform("members", lambda m: _hex(m["hash"])), ""), 256)
    parents = groups.select(
        "tree", F.col("up").alias("idx"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), F.unhex(digest).alias("hash")
    )
    nothing = F.lit(bytearray())
    others = [
        F.when(F.col("pos") != i, F.coalesce(F.get("members", F.lit(i))["hash"], nothing)).otherwise(nothing)
        for i in range(FAN)
    ]
    kind = F.col("pos") + FAN * (F.size("members") - 1)
    links = groups.select("tree", "up", "members", F.posexplode("members").alias("pos", "own")).select(
        "tree",
        F.lit(level).alias("level"),
        F.col("own.idx").alias("idx"),
        F.col("tree").alias("up_tree"),
        F.lit(level + 1).alias("up_level"),
        F.col("up").alias("up_idx"),
        F.concat(*others).alias("siblings"),
        kind.cast("string").alias("shape"),
        *(_payload(F.col("own.doc_id"), F.col("own.hash"), F.col("own.changed")) if carried else _payload()),
    )
    return links, parents


def _payload(doc_id: Column | None = None, leaf: Column | None = None, changed: Column | None = None) -> list[Column]:
    """What leaves carry along; inner nodes have none."""
    return [
        (F.lit(None) if doc_id is None else doc_id).alias("doc_id"),
        (F.lit(None) if leaf is None else leaf).cast("binary").alias("leaf"),
        (F.lit(None) if changed is None else changed).cast("binary").alias("changed"),
    ]


def _heights(leaves: int) -> int:
    """Levels above ``leaves`` leaves."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // FAN), levels + 1
    return levels


def _climb(nodes: DataFrame, levels: int, leaves: int, trees: int) -> tuple[list[DataFrame], DataFrame]:
    """All links inside the trees, and the node that is left of each with its level."""
    links, tops = [], []
    for level in range(levels + 1):
        carried = ("doc_id", "hash", "changed") if level == 0 and "doc_id" in nodes.columns else ()
        tops.append(
            nodes.filter("n = 1").select(
                "tree", F.lit(level).alias("level"), "hash", *_payload(*(F.col(c) for c in carried))
            )
        )
        if level < levels:
            found, nodes = _links(nodes, level, 1 + (leaves // FAN**level + trees) // NODES_PER_FILE)
            links.append(found)
    whole = tops[0]
    for more in tops[1:]:
        whole = whole.unionByName(more)
    return links, whole


def _jump(links: DataFrame, distance: int) -> DataFrame:
    """Links of twice the distance; ``distance`` is a power of two."""
    upper, level = F.col("tree") == UPPER, F.col("level")
    needed = links.filter(upper | (level % (2 * distance) == 0))
    ahead = links.filter(upper | ((level > 0) & (level % distance == 0))).select(
        *[F.col(c).alias(f"at_{c}") for c in _NODE],
        *[F.col(c).alias(f"next_{c}") for c in _UP],
        F.col("siblings").alias("more_siblings"),
        F.col("shape").alias("more_shape"),
    )
    same = [F.col(u) == F.col(f"at_{c}") for u, c in zip(_UP, _NODE)]
    going = needed.filter(F.col("up_tree").isNotNull())
    longer = going.join(ahead, same, "inner").select(
        *_NODE,
        *[F.col(f"next_{c}").alias(c) for c in _UP],
        F.concat("siblings", "more_siblings").alias("siblings"),
        F.concat("shape", "more_shape").alias("shape"),
        "doc_id",
        "leaf",
        "changed",
    )
    return needed.filter(F.col("up_tree").isNull()).unionByName(longer)


def merkle_manifest(documents: DataFrame) -> Manifest:
    """Trees over all rows of ``documents`` and a proof for each."""
    named = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("key")
    leaf, changed = F.col("leaf"), F.col("changed")
    leaves = (
        documents.select(named, "doc_id", leaf_hash().alias("leaf"), tampered_hash().alias("changed"))
        .select("key", "doc_id", F.unhex(leaf).alias("hash"), F.unhex(F.when(changed != leaf, changed)).alias("changed"))
    )
    placed, sources = _numbered(leaves)
    size = sources.agg(F.max("n").alias("largest"), F.count("*").alias("sources"), F.sum("n").alias("leaves")).first()
    leaf_count = size["leaves"] or 0
    lower, upper = _heights(size["largest"] or 0), _heights(size["sources"])
    links, tops = _climb(placed, lower, leaf_count, size["sources"])
    tops = store(tops.coalesce(1 + size["sources"] // NODES_PER_FILE))
    subroots = tops.select(
        F.lit(UPPER).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(size["sources"]).alias("n"), "hash"
    )
    above, root = _climb(subroots, upper, size["sources"], 1)
    found = root.select(_hex(F.col("hash")).alias("root")).first()
    crossing = tops.select(
        "tree",
        "level",
        F.lit(0).cast("long").alias("idx"),
        F.lit(UPPER).cast("long").alias("up_tree"),
        F.lit(0).alias("up_level"),
        F.col("tree").alias("up_idx"),
        F.lit(bytearray()).alias("siblings"),
        F.lit(BORDER).alias("shape"),
        "doc_id",
        "leaf",
        "changed",
    )
    for more in (*links, *above):
        crossing = crossing.unionByName(more)
    at_root = (F.col("up_tree") == UPPER) & (F.col("up_level") == upper)
    # One table: the rounds read it, not the groups of every level.
    files = 1 + 2 * leaf_count // NODES_PER_FILE
    chain = store(crossing.withColumns({c: F.when(~at_root, F.col(c)) for c in _UP}).coalesce(files))
    distance = 1
    while distance < lower + 1 + upper:
        chain = store(_jump(chain, distance))
        distance *= 2
    proofs = chain.filter(F.col("leaf").isNotNull()).select("doc_id", "leaf", "changed", "siblings", "shape")
    listed = sources.join(tops.select("tree", "hash"), "tree").select(
        F.when(F.col("key") != "", F.substring("key", 2, 2**31 - 1)).alias("source"),
        F.col("n").alias("n_leaves"),
        _hex(F.col("hash")).alias("subroot"),
    )
    return Manifest(found["root"] if found else None, listed, proofs)


def fold(leaf: Column, siblings: Column, shape: Column) -> Column:
    """Hash a leaf with its siblings up to the root: (subroot, root), hexadecimal."""

    def step(state: Column, code: Column) -> Column:
        kind = F.ascii(code) - ord("0")
        place, others = kind % FAN, F.floor(kind / FAN).cast("int")
        part = lambda begin, count: _hex(F.substring(siblings, begin, count * _BYTES))
        digest = F.sha2(
            F.concat(
                part(state["at"], place), state["hash"], part(state["at"] + place * _BYTES, others - place)
            ),
            256,
        )
        border = code == BORDER
        return F.struct(
            F.when(border, state["hash"]).otherwise(digest).alias("hash"),
            F.when(border, state["at"]).otherwise(state["at"] + others * _BYTES).cast("int").alias("at"),
            F.when(border, state["hash"]).otherwise(state["subroot"]).alias("subroot"),
        )

    codes = F.transform(F.sequence(F.lit(1), F.length(shape)), lambda i: F.substring(shape, i, F.lit(1)))
    begin = F.struct(
        _hex(leaf).alias("hash"), F.lit(1).alias("at"), F.lit(None).cast("string").alias("subroot")
    )
    return F.aggregate(
        codes, begin, step, lambda end: F.struct(end["subroot"].alias("subroot"), end["hash"].alias("root"))
    )


def verified_documents(documents: DataFrame) -> DataFrame:
    """Per document its leaf, subroot, root and proof, and whether the leaf after
    tampering still leads to the root."""
    manifest = merkle_manifest(documents)
    path = (F.col("siblings"), F.col("shape"))
    return (
        manifest.proofs.withColumn("_own", fold(F.col("leaf"), *path))
        .withColumn("_other", F.when(F.col("changed").isNotNull(), fold(F.col("changed"), *path)))
        .select(
            "doc_id",
            _hex(F.col("leaf")).alias("leaf"),
            F.col("_own.subroot").alias("subroot"),
            F.lit(manifest.root).cast("string").alias("root"),
            F.sha2(_hex(F.col("siblings")), 256).alias("proof_sha256"),
            F.coalesce("_other.root", "_own.root").alias("folded_root"),
        )
        .withColumn("verified", F.col("folded_root") == F.col("root"))
    )
