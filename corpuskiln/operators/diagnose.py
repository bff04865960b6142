"""Diagnosis of training rows: lengths, supervised labels, first supervised tokens, end marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from . import profile, tokens


def features(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` (prompt and output: ids, the output's with the end mark) with input_ids, labels and problem.

    ``problem`` is null, or empty_prompt, empty_output or too_long (more than ``most`` inputs); such rows have null features.
    """
    prompt, output = F.coalesce("prompt", F.array().cast("array<int>")), F.coalesce("output", F.array().cast("array<int>"))
    problem = F.when(F.size(prompt) == 0, "empty_prompt").when(F.size(output) == 0, "empty_output").when(~tokens.fits(prompt, output, most), "too_long")
    made = {"input_ids": tokens.input_ids(prompt, output), "labels": tokens.labels(prompt, output)}
    return rows.withColumn("problem", problem).withColumns({k: F.when(F.col("problem").isNull(), v) for k, v in made.items()})


def diagnosis(rows: DataFrame, by: str, end_id: int) -> DataFrame:
    """One row for each ``by`` of rows with features (id, output, input_ids, labels, problem): counts, lengths and the share of end marks.

    examples, problems, zero_supervised, first_is_end, only_end (outputs of nothing but end marks), end_label_ratio, and
    least, most, mean and median of the inputs (tokens_) and of the supervised labels (supervised_) of each example.
    """
    bare = F.size(F.array_remove("output", end_id)) == 0
    shown = rows.select(by, "problem", "input_ids", F.array_remove("labels", tokens.IGNORE).alias("s"), bare.alias("bare"))
    # array by array, so that no row is spread out
    ends = F.size("s") - F.size(F.array_remove("s", end_id))
    facts = shown.select(by, "problem", "bare", F.size("input_ids").alias("tokens"), F.size("s").alias("supervised"), ends.alias("ends"), F.get("s", F.lit(0)).alias("first"))
    # rows of equal lengths are counted together, in the only pass over the arrays
    sums = [F.count("*").alias("n"), F.sum("ends").alias("ends"), F.count_if(F.col("first") == end_id).alias("first_is_end"), F.count_if("bare").alias("only_end")]
    alike = stored(facts.groupBy(by, F.col("problem").isNull().alias("sound"), "tokens", "supervised").agg(*sums))
    sound = F.col("sound")
    total = lambda of, held=sound: F.coalesce(F.sum(F.when(held, of)), F.lit(0))
    n, labels = F.col("n"), F.col("n") * F.col("supervised")
    counts = alike.groupBy(by).agg(
        total(n).alias("examples"),
        total(n, ~sound).alias("problems"),
        total(n, sound & (F.col("supervised") == 0)).alias("zero_supervised"),
        total(F.col("first_is_end")).alias("first_is_end"),
        total(F.col("only_end")).alias("only_end"),
        F.round(F.sum(F.when(sound, F.col("ends"))) / F.nullif(F.sum(F.when(sound, labels)), F.lit(0)), 6).alias("end_label_ratio"),
    )
    out = counts
    for name in ("tokens", "supervised"):
        stats = profile.numbers(alike.where(sound), F.col(name), [by], n).select(F.col(by).alias("_by"), *[F.col(c).alias(f"{name}_{c}") for c in ("least", "most", "mean", "median")])
        out = out.join(stats, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")
    return out


def first_supervised(rows: DataFrame, by: str, order: str, most: int = 20) -> DataFrame:
    """by, place, token, n: the most frequent first supervised tokens of each ``by``; of equal counts the one that came first."""
    first = rows.where("problem IS NULL").select(by, F.col(order).alias("at"), F.get(F.filter("labels", lambda x: x != tokens.IGNORE), F.lit(0)).alias("token")).where("token IS NOT NULL")
    counts = first.groupBy(by, "token").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    ranked = counts.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "at", "token")))
    return ranked.where(F.col("place") <= most).select(by, "place", "token", "n")
