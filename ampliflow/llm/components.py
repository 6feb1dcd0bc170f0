"""Connected components of a graph of links, as Spark jobs: contraction to smaller neighbours, round by round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import row_count, small, written


def _relabelled(df: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """df with labels' label in place of a node that it names; other nodes stay."""
    of = small(labels).select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    return df.join(of, df[column] == F.col("_node"), "left").withColumn(column, F.coalesce("_label", column)).drop("_node", "_label")


def connected(links: DataFrame) -> DataFrame:
    """links: a, b (longs). Returns a written table with a row for each node of a link: node, label (the least node that it reaches).

    Each round every node points to its least neighbour (if that is less), pointers are followed, and links between the nodes that
    are left go to the next round. Their number at least halves, so the rounds are few. Minima are taken before the shuffle, so a
    node with very many links is no hot key."""
    links = written(links.select("a", "b").where(F.col("a") != F.col("b")).distinct(), "links")
    labels = None
    while True:
        both = links.union(links.select(F.col("b"), F.col("a")))
        to = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label"))
        to = written(to, "pointers")
        to = written(_relabelled(to, "label", to), "pointers")
        labels = to if labels is None else _relabelled(labels, "label", to)
        links = _relabelled(_relabelled(links, "a", to), "b", to).where(F.col("a") != F.col("b")).distinct()
        links, labels = written(links, "links"), written(labels, "labels")
        if not row_count(links):
            return labels
