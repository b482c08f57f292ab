"""Training samples of labelled documents, bounded and without held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows whose remainder is 0 are held out.
FOLDS = 5


def held_out(doc_id: str = "doc_id", folds: int = FOLDS) -> Column:
    """Whether crc32 of the id as text leaves remainder 0; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def training_ids(labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, label of at most ``most`` labelled rows in a fixed random order of
    their ids. An id with several labels takes the largest."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
    one = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def training_texts(documents: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, label, text of the sample; only its ids are broadcast, at most ``most``."""
    ids = training_ids(labels, label, most)
    return documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
