"""Benchmark decontamination: a prefix-filtered join of documents with item windows.

An item's windows are its runs of ``window`` consecutive words; an item of fewer
words, but not none, is one window. A document is contaminated where a window
occurs in it.

A window is a set of shingles (runs of ``shingle`` words, fewer in a shorter
window) at known offsets. It occurs only where all of them do, so one necessary
token is enough to find it: the rarest. The steps:

1. positions of the documents whose shingle is one of the benchmark's, by a
   broadcast join inside the scan; they leave the scan with the words around
   them, and each document leaves one row of its own;
2. rarity: occurrences of every benchmark shingle over all documents;
3. each window's prefix is its rarest shingle; positions with a prefix token
   meet the window; length and position bounds discard windows that would start
   before or end behind the document;
4. the words there are compared with the window's words exactly;
5. per document, the union of the hit intervals and the set of items.

The benchmark is worked off in blocks of ``BLOCK_WINDOWS`` windows, so what is
broadcast is bounded at any size of it. No row of a document is grouped by a
token: a passage that many documents share costs each of them its own rows.

Edge cases: a null or empty text has no words and is clean. Rows are identified
by id and text; repeated rows come back as often as they came. An item without
words has no window; a null item id counts as an item but is not in the list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import store
from .columns import carries_other_columns

# Words are runs of characters outside this class, after lower-casing A-Z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW, SHINGLE = 10, 5
# Windows of a block: with its words at most a few dozen MB are broadcast.
BLOCK_WINDOWS = 100_000


def words(text: Column) -> Column:
    """The words of a text; none for a null text."""
    pieces = F.split(F.translate(text, UPPER, LOWER), SEPARATORS)
    return F.coalesce(F.array_remove(pieces, ""), F.array().cast("array<string>"))


def token(words_: Column, at: Column, size: int) -> Column:
    """Hash of ``size`` words from position ``at`` (0-based); null if they end sooner."""
    run = [F.get(words_, at + i) for i in range(size)]
    return F.when(run[-1].isNotNull(), F.xxhash64(*run))


def item_windows(benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """item_id, window (words), size (words of its shingles), and the shingles."""
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    windows = items.select("item_id", "words", F.explode(starts).alias("start")).select(
        "item_id", F.slice("words", F.col("start") + 1, window).alias("window")
    )
    windows = windows.groupBy("window").agg(F.collect_set("item_id").alias("items"), F.count("*").alias("uses"))
    size = F.least(F.size("window"), F.lit(shingle))
    sized = windows.withColumn("size", size).withColumn(
        "offset", F.explode(F.sequence(F.lit(0), F.size("window") - F.col("size")))
    )
    run = [
        F.when(F.col("size") > i, F.get("window", F.col("offset") + i)).otherwise(F.lit(None))
        for i in range(shingle)
    ]
    # xxhash64 leaves out nulls: equal to the hash of the first ``size`` words.
    return sized.withColumn("token", F.xxhash64(*run))


def _positions(documents: DataFrame, tokens: DataFrame, sizes: list[int], window: int) -> DataFrame:
    """One row per document (place null) and one per position with a benchmark token."""
    fingerprint = F.xxhash64("text", F.length("text"))
    texts = documents.select("doc_id", fingerprint.alias("text_key"), words(F.col("text")).alias("words"))
    marked = texts.select(
        "doc_id", "text_key", "words", F.posexplode(F.concat("words", F.array(F.lit(None).cast("string")))).alias("place", "word")
    )
    hashed = reduce(
        DataFrame.unionAll,
        [
            marked.select(
                "doc_id", "text_key", "words", "place", "word", F.lit(size).alias("size"),
                token(F.col("words"), F.col("place"), size).alias("token"),
            )
            for size in sizes
        ],
    ) if len(sizes) > 1 else marked.withColumn("size", F.lit(sizes[0])).withColumn(
        "token", token(F.col("words"), F.col("place"), sizes[0])
    )
    met = hashed.join(F.broadcast(tokens.withColumn("met", F.lit(True))), ["token", "size"], "left")
    low = F.greatest(F.col("place") - window + 1, F.lit(0))
    own = F.col("word").isNull() & (F.col("size") == sizes[0])
    return met.filter(F.col("met") | own).select(
        "doc_id",
        "text_key",
        F.size("words").alias("n_words"),
        F.when(F.col("met"), F.col("place")).alias("place"),
        F.when(F.col("met"), F.col("token")).alias("token"),
        F.when(F.col("met"), low).alias("low"),
        F.when(F.col("met"), F.slice("words", low + 1, 2 * window - 1)).alias("around"),
    )


def _covered(spans: Column) -> Column:
    """Words covered by the union of sorted (start, end) spans."""
    begin = F.struct(F.lit(0).alias("words"), F.lit(0).alias("upto"))
    return F.aggregate(
        spans,
        begin,
        lambda seen, span: F.struct(
            (
                seen["words"]
                + F.greatest(span["end"] - F.greatest(span["start"], seen["upto"]), F.lit(0))
            ).alias("words"),
            F.greatest(seen["upto"], span["end"]).alias("upto"),
        ),
        lambda seen: seen["words"],
    )


def contamination(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE
) -> DataFrame:
    """Per document: doc_id, text_key, copies, n_words, n_hit, n_items, items_sha256,
    contaminated; identical rows are one row with their number in ``copies``."""
    windows = store(item_windows(benchmark, window, shingle))
    blocks = -(-windows.count() // BLOCK_WINDOWS) or 1
    sizes = sorted(row[0] for row in windows.select("size").distinct().collect()) or [shingle]
    spans = []
    for block in range(blocks):
        part = windows.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block)
        places = store(_positions(documents, part.select("token", "size").distinct(), sizes, window))
        rarity = places.filter("token is not null").groupBy("token").agg(F.count("*").alias("uses"))
        prefix = (
            part.drop("uses")
            .join(F.broadcast(rarity), "token", "left")
            .groupBy("window", "items")
            .agg(
                F.min(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "token", "offset")).alias("rarest")
            )
            .filter("rarest.uses > 0")
            .select("window", "items", F.col("rarest.token").alias("token"), F.col("rarest.offset").alias("offset"))
        )
        start = F.col("place") - F.col("offset")
        end = start + F.size("window")
        inside = F.slice("around", start - F.col("low") + 1, F.size("window"))
        hits = (
            places.filter("token is not null")
            .join(F.broadcast(prefix), "token")
            .filter((start >= 0) & (end <= F.col("n_words")))
            .filter(inside == F.col("window"))
            .select(
                "doc_id", "text_key", "n_words", F.lit(0).alias("own"),
                F.struct(start.alias("start"), end.alias("end")).alias("span"), "items",
            )
        )
        spans.append(hits)
        if block == 0:
            own = F.lit(1).alias("own")
            spans.append(
                places.filter("place is null").select(
                    "doc_id", "text_key", "n_words", own,
                    F.lit(None).cast("struct<start:int,end:int>").alias("span"),
                    F.lit(None).cast(part.schema["items"].dataType).alias("items"),
                )
            )
    found = reduce(DataFrame.unionAll, spans)
    one = found.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"),
        F.sum("own").alias("copies"),
        F.sort_array(F.collect_set("span")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    listed = F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ",")
    return one.select(
        "doc_id",
        "text_key",
        "copies",
        F.col("n_words").cast("long").alias("n_words"),
        _covered(F.col("spans")).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def decontamination_report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document row, without the internal columns."""
    report = contamination(documents, benchmark)
    repeated = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return report.withColumn("_copy", repeated).drop("_copy", "copies", "text_key")


@carries_other_columns("doc_id", "text")
def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a benchmark passage, all columns as they came."""
    bad = contamination(documents, benchmark).filter("contaminated").select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (
        F.xxhash64("text", F.length("text")) == F.col("_key")
    )
    return documents.join(bad, same, "left_anti")
