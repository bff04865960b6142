"""Audit of a built set: clusters and counts of near duplicates, a training log's summary, the conclusion from counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dedup import gram_groups


def near_clusters(rows: DataFrame, threshold: float = 0.86, least: int = 4, matches: int = 5, clusters: int = 50) -> DataFrame:
    """id, other, jaccard: the first ``clusters`` rows with earlier near duplicates, each with the first ``matches`` of them.

    ``rows``: id, grams; rows of fewer than ``least`` distinct grams take no part, and order is that of id.  Of each
    group of equal sets only its first ids are asked for, so copies are never paired with one another.
    """
    ids, near = gram_groups(rows.select("id", F.lit("").alias("within"), "grams"), F.col("size") >= least, threshold, dense=True)
    near = near.join(near.select(F.col("g").alias("h")).distinct(), "h", "left_semi")
    first = lambda df, key, by: df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(by))).where(F.col("_r") <= matches).drop("_r")
    members = first(ids, "node", "id").select(F.col("node").alias("h"), F.col("id").alias("other"))
    others = first(near.join(members, "h").select(F.col("g").alias("node"), "other", "jaccard"), "node", "other")
    hits = ids.join(others, "node").where("other < id").groupBy("id").agg(F.collect_list(F.struct("other", "jaccard")).alias("hits"))
    return hits.orderBy("id").limit(clusters).select("id", F.explode("hits").alias("hit")).select("id", "hit.other", "hit.jaccard")


def near_pair_counts(rows: DataFrame, threshold: float = 0.82, n: int = 1, dense: bool = False) -> DataFrame:
    """within, pairs: how many pairs of rows (id, within, grams; runs of ``n``) reach the threshold; empty sets and a null ``within`` are like nothing.

    Counted from pairs of distinct sets and the number of rows of each, so n copies cost one row and not n squared.
    """
    ids, near = gram_groups(rows.where("within IS NOT NULL"), F.lit(True), threshold, n, dense)
    counts = ids.groupBy("node").agg(F.count("*").alias("n"))
    both = near.where("g <= h").join(counts.select(F.col("node").alias("g"), F.col("n").alias("n_g")), "g").join(counts.select(F.col("node").alias("h"), F.col("n").alias("n_h")), "h")
    pairs = F.when(F.col("g") == F.col("h"), F.expr("n_g * (n_g - 1) div 2")).otherwise(F.col("n_g") * F.col("n_h"))
    return both.groupBy("within").agg(F.sum(pairs).alias("pairs"))


def log_summary(log: DataFrame, order: str, train: str, val: str, tail: int = 5) -> DataFrame:
    """One row: the last record's training loss, the least validation loss, and the last records in order: their places and the whole records."""
    record = F.struct(order, *[c for c in log.columns if c != order])
    last = log.orderBy(F.desc(order)).limit(tail).agg(F.array_sort(F.collect_list(record)).alias("records")).select(F.transform("records", lambda r: r[order]).alias("tail"), "records")
    return log.agg(F.max_by(train, order).alias("final_train_loss"), F.min(val).alias("best_val_loss")).crossJoin(F.broadcast(last))


def conclusion(rows: Column, rejected: Column, pair_copies: Column, output_copies: Column) -> Column:
    """What the counts speak for: a filter that rejects too much, bad data, or neither."""
    harsh = (rejected / F.greatest(rows, F.lit(1)) > 0.5) & (pair_copies < rejected * 0.25)
    bad = (pair_copies > rejected * 0.5) | (output_copies > rows)
    return (
        F.when(rejected == 0, "Mixed evidence")
        .when(harsh, "Evidence suggests build filter is over-aggressive")
        .when(bad, "Evidence suggests data is bad")
        .otherwise("Mixed evidence")
    )
