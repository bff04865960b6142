"""Deterministic orders by hash, caps, stratified split, interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: int, *parts: str) -> Column:
    """A portable random order: md5 of the seed and the columns, joined by colons."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]))


def capped(df: DataFrame, group: str, task: str, task_cap: int | None, cap: int | None, seed: int, key: str) -> DataFrame:
    """At most ``task_cap`` of each task in a group, then at most ``cap`` of each group, in hash order."""
    out = df.withColumn("_order", hash_order(seed, group, key))
    for columns, most in (([group, task], task_cap), ([group], cap)):
        if most is not None:
            out = out.withColumn("_n", F.row_number().over(Window.partitionBy(*columns).orderBy("_order", key))).where(F.col("_n") <= most).drop("_n")
    return out.drop("_order")


def hash_rank(df: DataFrame, by: str, order: Column, key: str, name: str) -> DataFrame:
    """``df`` with the rank (from 1) of each row in its group, by ``order`` (a hash in hexadecimal), then ``key``.

    Rows are ranked within parts of a group that hold a prefix of the hash each, and the parts' counts are added up, so
    a group of any size is spread over tasks.
    """
    parted = df.withColumn("_hash", order).withColumn("_part", F.substring("_hash", 1, 3))
    counts = parted.groupBy(F.col(by).alias("_by"), F.col("_part").alias("_of")).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("_by").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    placed = parted.withColumn("_place", F.row_number().over(Window.partitionBy(by, "_part").orderBy("_hash", key)))
    joined = placed.join(before, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_of")))
    return joined.withColumn(name, F.col("_before") + F.col("_place")).drop("_hash", "_part", "_by", "_of", "_before", "_place")


def hash_head(df: DataFrame, order: Column, count: int) -> DataFrame:
    """The rows of ``df`` whose ``order`` (a hash in hexadecimal) has one of the least prefixes; they hold the first ``count`` rows."""
    prefix = F.substring(order, 1, 3)
    parts = df.groupBy(prefix.alias("_of")).agg(F.count("*").alias("_n"))  # a row for each prefix
    before = parts.select("_of", F.coalesce(F.sum("_n").over(Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    last = before.where(F.col("_before") < count).agg(F.max("_of")).first()[0]
    return df.where(prefix <= F.lit(last).cast("string"))


def stratified_split(df: DataFrame, stratum: str, key: str, ratio: float, seed: int) -> DataFrame:
    """``df`` with split: val for round(n * ratio) of each stratum, one at least and all but one at most; a single row trains."""
    sizes = df.groupBy(F.col(stratum).alias("_stratum")).agg(F.count("*").alias("_size"))
    ranked = hash_rank(df, stratum, hash_order(seed, stratum, key), key, "_rank").join(sizes, F.col(stratum).eqNullSafe(F.col("_stratum")))
    size = F.col("_size")
    wanted = F.when((size <= 1) | (F.lit(ratio) <= 0), 0).otherwise(F.least(size - 1, F.greatest(F.lit(1), F.bround(size * F.lit(ratio)))))
    return ranked.withColumn("split", F.when(F.col("_rank") <= wanted, "val").otherwise("train")).drop("_rank", "_size", "_stratum")


def sample_per_group(df: DataFrame, group: str, key: str, k: int, seed: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(hash_order(seed, group, key), key))).where(F.col("_n") <= k).drop("_n")


def interleaved_shards(df: DataFrame, category: str, key: str, shard_size: int, seed: int) -> DataFrame:
    """``df`` with position and shard: one row of each category in turn, categories by name, cut into shards.

    The global position needs no global sort: it is the number of rows of smaller index within their category, from
    the categories' sizes, plus the number of smaller categories that reach the index.
    """
    sizes = df.groupBy(F.col(category).alias("_c")).agg(F.count("*").alias("_n"))
    placed = hash_rank(df, category, hash_order(seed, category, key), key, "_index")
    # rows of smaller index: by size of category, those that end before an index and those that reach it
    steps = sizes.groupBy("_n").agg(F.count("*").alias("_k"))
    ended = Window.orderBy("_n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = steps.select(F.col("_n").alias("_to"), F.lag("_n", 1, 0).over(Window.orderBy("_n")).alias("_from"), F.sum(F.col("_n") * F.col("_k")).over(ended).alias("_rows"), F.sum("_k").over(ended).alias("_done"))
    total = sizes.agg(F.count("*").alias("_all"))
    ends = ends.crossJoin(total).select("_from", "_to", (F.coalesce(F.lag("_rows").over(Window.orderBy("_to")), F.lit(0))).alias("_full"), (F.col("_all") - F.coalesce(F.lag("_done").over(Window.orderBy("_to")), F.lit(0))).alias("_open"))
    # within a span of indexes the same categories are open; the row's place among them is a rank of names
    spans = sizes.join(ends, F.col("_n") >= F.col("_to")).select(F.col("_c").alias("_name"), "_from", "_to", "_full", "_open", (F.row_number().over(Window.partitionBy("_to").orderBy("_c")) - 1).alias("_ahead"))
    joined = placed.join(spans, F.col(category).eqNullSafe(F.col("_name")) & (F.col("_index") > F.col("_from")) & (F.col("_index") <= F.col("_to")))
    position = F.col("_full") + (F.col("_index") - 1) * F.col("_open") + F.col("_ahead")
    return joined.withColumn("position", position).withColumn("shard", F.floor(F.col("position") / shard_size)).select(*df.columns, "position", "shard")
