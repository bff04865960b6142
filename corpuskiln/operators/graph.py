"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def components(links: DataFrame) -> DataFrame:
    """node, label of every node of ``links`` (a, b: long); the label is the least node of its component.

    Every node first goes to the least of its neighbours and itself, so that a close group is one node from then on and
    its links go.  Then, in each round, a node takes the least label of its neighbours, and then the label of that label,
    so rounds grow with the logarithm of a component's width.  They end when no label moves.
    """
    once = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    first = stored(_both(once).groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("first")))
    of = lambda x: first.select(F.col("node").alias(x), F.col("first").alias(f"first_{x}"))
    moved = once.where("a <> b").join(of("a"), "a").join(of("b"), "b").where("first_a <> first_b")
    left = _labels(stored(_both(moved.select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))).distinct()))
    return first.join(left.select(F.col("node").alias("first"), "label"), "first", "left").select("node", F.coalesce("label", "first").alias("label"))


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _labels(both: DataFrame) -> DataFrame:
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        offers = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("offer"))
        nearer = labels.join(offers, "node").select("node", "label", F.least("label", "offer").alias("next"))
        jumps = labels.select(F.col("node").alias("next"), F.col("label").alias("jump"))
        found = stored(nearer.join(jumps, "next").select("node", "label", F.least("next", "jump").alias("new")))
        labels = found.select("node", F.col("new").alias("label"))
        if not found.where("new <> label").limit(1).collect():
            return labels
