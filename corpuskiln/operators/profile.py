"""Counts, length distributions and most frequent values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numbers(df: DataFrame, value: Column, by: list[str], times: Column | None = None) -> DataFrame:
    """n, least, most, mean (3 places), median (3 places), p90 (the value at 0.9 (n - 1), rounded down).

    ``times`` says how often a row counts, once by default.  The positional p90 and the median come from counts of each value, so a large group is never gathered in one row.
    """
    counted = df.select(*by, value.alias("v"), (F.lit(1) if times is None else times).alias("c")).where("v IS NOT NULL").groupBy(*by, "v").agg(F.sum("c").alias("c"))
    exact = counted.groupBy(*by).agg(
        F.sum("c").alias("n"),
        F.min("v").alias("least"),
        F.max("v").alias("most"),
        F.bround(F.sum(F.col("v") * F.col("c")) / F.sum("c"), 3).alias("mean"),
        F.array_sort(F.collect_list(F.struct("v", "c"))).alias("values"),
    )
    at = lambda k: F.aggregate(
        "values",
        F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("found")),
        lambda s, x: F.struct((s["seen"] + x["c"]).alias("seen"), F.when(s["found"].isNull() & (s["seen"] + x["c"] > k), x["v"].cast("double")).otherwise(s["found"]).alias("found")),
    )["found"]
    n = F.col("n")
    median = (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2
    return exact.select(*by, "n", "least", "most", "mean", F.bround(median, 3).alias("median"), at(F.floor(0.9 * (n - 1))).alias("p90"))


def most_common(values: DataFrame, value: str, order: str, k: int) -> DataFrame:
    """value, n of the k most frequent values; of equal counts the one that came first."""
    return values.groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("_first")).orderBy(F.desc("n"), "_first", value).limit(k).drop("_first")


def grouped_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """dim, key, n: counts by each column in one pass."""
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).cast("string").alias("key")) for c in columns]))
    return df.select(stacked.alias("x")).groupBy("x.dim", "x.key").agg(F.count("*").alias("n"))
