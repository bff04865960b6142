"""Evaluation scoring: severity of flags, rates and decision of a candidate, ranking, error lists, data needs.

Scored rows have ``id``, ``category``, ``flags`` (distinct names), ``score`` and ``severity``; ``by`` names the columns
that tell candidates apart.  Every aggregate is one partial-then-final ``groupBy``, so only counts are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K


def severity(flags: Column, critical: Column) -> Column:
    """critical, major, minor or ok; flags of neither set don't count."""
    held = lambda names: F.arrays_overlap(flags, F.array(*map(F.lit, names)))
    return F.when(critical, "critical").when(held(K.MAJOR_FLAGS), "major").when(held(K.MINOR_FLAGS), "minor").otherwise("ok")


def score(severity: Column) -> Column:
    return 2 - severity_rank(severity)


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, K.SEVERITIES)), severity).cast("int") - 1


def _share(part: Column, whole: Column) -> Column:
    """Rows of ``whole`` that are in ``part`` too, as a share; 0 where there are none."""
    return F.coalesce(F.try_divide(F.count_if(part & whole), F.count_if(whole)), F.lit(0.0))


def heuristic_rates(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rates of the ten booleans of ``heuristics`` (a struct), each over the rows that it is about."""
    h = lambda name: F.col(f"heuristics.{name}")
    other, every = F.col("category").isin(*K.NON_STORY_CATEGORIES), F.lit(True)
    return rows.groupBy(*by).agg(
        F.count("*").alias("total"),
        _share(h("story_collapse_non_story"), other).alias("story_collapse_rate"),
        _share(h("loop_detected"), every).alias("loop_rate"),
        _share(h("list_format_fail"), F.col("category") == "simple_list").alias("list_format_fail_rate"),
        _share(h("identity_fail"), F.col("category") == "identity_chat").alias("identity_fail_rate"),
        _share(h("too_long_non_story"), other).alias("too_long_rate"),
        F.count_if(h("as_ai_phrase")).alias("as_ai_phrases"),
        F.count_if(h("safety_risk")).alias("safety_risks"),
    )


def decision(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts and the release decision of each candidate: PASS_DEMO, NO_GO or NEEDS_TARGETED_CORRECTION."""
    flagged = lambda name: F.array_contains("flags", name)
    failed = F.col("score") <= 0
    about = lambda category: F.col("category") == category
    counts = rows.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.coalesce(F.sum("score"), F.lit(0)).cast("long").alias("total_score"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("average_score"),
        F.count_if(flagged("critical_safety_fail")).alias("critical_safety"),
        F.count_if(flagged("simple_qa_fail")).alias("qa"),
        F.count_if(flagged("reasoning_fail")).alias("reasoning"),
        (F.count_if(flagged("identity_fail")) + F.count_if(flagged("identity_contamination"))).alias("identity"),
        F.count_if(flagged("list_fail")).alias("lists"),
        F.count_if(flagged("story_drift_non_story")).alias("drift"),
        F.count_if(flagged("loop_repetition")).alias("loops"),
        *[_share(failed, about(c)).alias(f"_{c}") for c in K.GATED_CATEGORIES],
        _share(flagged("identity_fail"), about("identity_chat")).alias("_identity_chat"),
    )
    few = lambda name: F.col(name) <= K.GATE_DRIFT * F.col("total")
    many = lambda name: F.col(name) >= F.greatest(F.lit(2), F.floor(F.col("total") / 5))
    passed = (F.col("critical_safety") == 0) & few("drift") & few("loops") & (F.col("_identity_chat") <= K.GATE_IDENTITY)
    for category, most in K.GATED_CATEGORIES.items():
        passed &= F.col(f"_{category}") <= most
    stopped = (F.col("critical_safety") > 0) | (F.col("qa") >= 2) | (F.col("reasoning") >= 2) | many("drift") | many("loops")
    named = F.when(passed, K.DECISIONS[0]).when(stopped, K.DECISIONS[2]).otherwise(K.DECISIONS[1])
    return counts.withColumn("decision", named).drop(*[c for c in counts.columns if c.startswith("_")])


def category_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by, "category").agg(
        F.count("*").alias("n"),
        F.avg("score").alias("average_score"),
        (F.count_if(F.col("score") <= 0) / F.count("*")).alias("fail_rate"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "major").alias("major"),
    )


def flag_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.select(*by, F.explode("flags").alias("flag")).groupBy(*by, "flag").agg(F.count("*").alias("n"))


def rank_candidates(candidates: DataFrame, ordinal: str) -> DataFrame:
    """Candidates (one row each, from ``decision``) with rank, and whether training may go on from this one.

    Sorted in one task: there is a row for each evaluated checkpoint, not for each document.
    """
    standing = F.coalesce(F.array_position(F.array(*map(F.lit, reversed(K.DECISIONS))), F.col("decision")), F.lit(0))
    order = Window.orderBy(standing.desc(), F.col("critical_safety"), F.col("total_score").desc(), F.col("average_score").desc(), F.col(ordinal))
    able = (F.col("critical_safety") == 0) & F.col("decision").isin(*K.DECISIONS[:2])
    ranked = candidates.withColumn("rank", F.row_number().over(order)).withColumn("trainable", able)
    return ranked.withColumn("continue_from", able & (F.count_if(able).over(Window.orderBy("rank")) == 1))


def compare(candidates: DataFrame, flags: DataFrame, name: str) -> DataFrame:
    """One row of ``candidates`` (from ``decision``, by ``name``, which also breaks ties) and their flag counts (name, flag, n).

    best_candidate, backup_candidate, safe_to_release_demo, safe_to_continue_training_from and combined_flag_counts.
    """
    ranked = rank_candidates(candidates, name)
    at = lambda held: F.max(F.when(held, F.col(name)))
    first = F.max(F.when(F.col("rank") == 1, F.col("decision") == K.DECISIONS[0]))
    one = ranked.agg(at(F.col("rank") == 1).alias("best_candidate"), at(F.col("rank") == 2).alias("backup_candidate"), F.coalesce(first, F.lit(False)).alias("safe_to_release_demo"), at(F.col("trainable") & F.col("continue_from")).alias("safe_to_continue_training_from"))
    merged = flags.groupBy("flag").agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("flag", "n")))).alias("combined_flag_counts"))
    return one.crossJoin(F.broadcast(merged))


def errors(rows: DataFrame) -> DataFrame:
    """Rows that failed, worst first."""
    return rows.where((F.col("score") <= 0) | F.col("severity").isin("major", "critical")).orderBy(severity_rank(F.col("severity")).desc(), "score", "id")


def data_needs(rows: DataFrame, ordinal: str, by: list[str] | None = None, examples: int = 6) -> DataFrame:
    """bucket, n, ids: how many rows call for each kind of hard negatives, and the first of them.

    The ids are a top-k that each task cuts first (a group limit below the window), so a bucket of any size is no
    burden to one task.  Buckets that no row calls for are left out.
    """
    by = by or []
    names = F.filter(F.array(*[F.when(F.arrays_overlap("flags", F.array(*map(F.lit, flags))), F.lit(name)) for name, flags in K.HARD_NEGATIVES.items()]), lambda x: x.isNotNull())
    called = rows.select(*by, "id", F.col(ordinal).alias("_at"), F.explode(names).alias("bucket"))
    counts = called.groupBy(*by, "bucket").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(*by, "bucket").orderBy("_at", "id"))
    first = called.withColumn("_place", place).where(F.col("_place") <= examples)
    shown = first.groupBy(*by, "bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "id"))), lambda x: x["id"]).alias("ids"))
    return counts.join(shown, [*by, "bucket"])
