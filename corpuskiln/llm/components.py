"""Connected components over a table of links, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """node, label for every node of ``links`` (a, b: long); label is the component's least node.

    Each round takes the least label among a node's neighbours and then the label's own label, so the rounds grow
    with the logarithm of a chain's length; they go on until no label moves, which must come as labels only fall.  Labels are written to the shared folder every round.  Nodes with very many
    links are pre-aggregated (minimum), and their joins are left to the adaptive skew split.
    """
    both = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        seen = labels.select(F.col("node").alias("b"), F.col("label").alias("seen"))
        offered = both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("offer"))
        nearer = labels.join(offered, "node").select("node", "label", F.least("label", "offer").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("jumped"))
        new = materialize(nearer.join(jump, "next", "left").select("node", F.least("next", F.coalesce("jumped", "next")).alias("label"), (F.least("next", F.coalesce("jumped", "next")) != F.col("label")).alias("moved")), "labels")
        labels = new.select("node", "label")
        if not new.where("moved").limit(1).collect():
            return labels
