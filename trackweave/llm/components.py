"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import store


def connected_components(links: DataFrame) -> DataFrame:
    """Label every node of ``links`` (a, b) with the smallest node it can reach.

    Each round a node takes the smallest label among its neighbours and itself,
    then the label of that label, so chains shorten by halves. Rounds are stored
    tables, which survive lost executors. Links of equal labels are dropped on
    the way: what is left shrinks to nothing. No links: no rows.
    """
    both = links.filter("a != b").select("a", "b").union(links.filter("a != b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = store(both.distinct())
    labels = None
    while True:
        nearest = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label"))
        nearest = store(nearest.select(F.col("a").alias("node"), "label"))
        if nearest.limit(1).count() == 0:
            break
        up = nearest.select(F.col("node").alias("label"), F.col("label").alias("above"))
        step = store(
            nearest.join(up, "label", "left").select(
                "node", F.least("label", F.coalesce("above", "label")).alias("label")
            )
        )
        if labels is None:
            labels = step
        else:
            ahead = step.select(F.col("node").alias("label"), F.col("label").alias("above"))
            labels = store(
                labels.join(ahead, "label", "left").select(
                    "node", F.coalesce("above", "label").alias("label")
                )
            )
        a = step.select(F.col("node").alias("a"), F.col("label").alias("left"))
        b = step.select(F.col("node").alias("b"), F.col("label").alias("right"))
        edges = store(
            edges.join(a, "a")
            .join(b, "b")
            .filter("left != right")
            .select(F.col("left").alias("a"), F.col("right").alias("b"))
            .distinct()
        )
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0)
    return labels
