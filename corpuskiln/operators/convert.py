"""Converters of public question rows: ordered filters, then the task type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from . import stream
from .rules import first_failure


def public_reason(category: Column, instruction: Column, context: Column, output: Column) -> Column:
    """The first filter that a public question row fails, or null."""
    n = T.word_count(output)
    limit = K.PUBLIC_LIMITS
    either = lambda terms: T.has_term(instruction, list(terms)) | T.has_term(output, list(terms))
    long = F.regexp_count(output, F.lit("[A-Za-z]{12,}"))
    return first_failure(
        [
            (category.isin(*K.DISCARDED_CATEGORIES), "discard_category"),
            (~F.coalesce(category.isin(*K.KEPT_CATEGORIES), F.lit(False)), "unknown_category"),
            (T.strip(context) != "", "has_context"),
            (F.contains(output, F.lit("`")), "output_has_code_block"),
            (either(K.CODE_TERMS), "contains_code_terms"),
            (either(K.ADULT_TERMS), "contains_adult_terms"),
            (n < limit["least_output"], "output_too_short"),
            (n > limit["most_output"], "output_too_long"),
            (T.word_count(instruction) > limit["most_instruction"], "instruction_too_long"),
            (instruction.rlike(K.FACT_QUESTION) & (n > limit["most_fact_output"]), "factual_qa_too_long"),
            (long > limit["most_long_words"], "too_many_long_words"),
            (T.digits(output) > limit["most_digits"], "too_many_digits"),
            (output.rlike(r"https?://\S+|www\.\S+"), "output_has_url"),
            (T.pipe_row(output), "output_has_markdown_table"),
            (output.rlike(K.FORMAL_TONE), "formal_tone"),
            (T.as_an_ai(output, bounded=True), "as_an_ai"),
        ]
    )


def public_task(category: Column, instruction: Column, output: Column) -> Column:
    """The task type of a kept category."""
    both = F.concat_ws(" ", instruction, output)
    return (
        F.when(category == "creative_writing", F.when(T.has_cue(both, list(K.STORY_WORDS)), "story_writing").otherwise("creative_generation"))
        .when(category == "generation", F.when(T.has_cue(instruction, list(K.STRUCTURE_WORDS)), "structured_output").otherwise("creative_generation"))
        .when(category == "brainstorming", "structured_output")
        .when(category == "classification", "simple_reasoning")
        .when(category == "open_qa", F.when(instruction.rlike(K.EXPLAIN_QUESTION), "explanation_for_children").otherwise("simple_qa"))
    )


def public_rows(rows: DataFrame) -> DataFrame:
    """``rows`` (id, category, instruction, context, response) with reason (null: kept) and task_type."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    reason = public_reason(F.col("category"), text("instruction"), text("context"), text("response"))
    tagged = rows.withColumn("reason", reason)
    return tagged.withColumn("task_type", F.when(F.col("reason").isNull(), public_task(F.col("category"), text("instruction"), text("response"))))


def converted(rows: DataFrame, order: list[str], source: str = "public_lite") -> DataFrame:
    """Kept rows of ``public_rows`` as raw rows: id (``source`` and a running number in the order of ``order``), task_type, texts, category.

    Numbers are running sums over ranges of the rows, so no task sees them all.
    """
    flagged = public_rows(rows).withColumn("_kept", F.col("reason").isNull().cast("int"))
    placed = stream.running_sum(flagged, order, "_kept", "earlier").where("_kept = 1")
    number = (F.col("earlier") + 1).cast("string")
    new_id = F.concat(F.lit(f"{source}_"), F.when(F.length(number) >= 6, number).otherwise(F.lpad(number, 6, "0")))
    text = lambda c: T.strip(F.coalesce(F.col(c), F.lit("")))
    return placed.select(new_id.alias("id"), F.lit(source).alias("source"), "task_type", text("instruction").alias("instruction"), F.lit("").alias("input"), text("response").alias("output"), F.lit("en").alias("language"), "category")


def conversion_manifest(rows: DataFrame) -> DataFrame:
    """dim (category, task_type, reason), key, n of ``public_rows``: categories of all rows, task types of kept ones, reasons of others."""
    entries = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("dim"), F.col(c).alias("key"))) for c in ("category", "task_type", "reason")]))
    return rows.select(F.explode(entries).alias("x")).groupBy("x.dim", "x.key").agg(F.count("*").alias("n"))
