"""Row validators: ordered rules, of which the first that fails names the reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T


def first_failure(rules: list[tuple[Column, str]]) -> Column:
    """The name of the first rule whose condition holds, or null."""
    return F.coalesce(*[F.when(condition, F.lit(name)) for condition, name in rules], F.lit(None).cast("string"))


def raw_row(keys: Column, row: Column, error: Column, metadata_is_object: Column) -> Column:
    """Structure of a raw row: a missing key is told from a null value by the keys of its JSON."""
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, K.REQUIRED_FIELDS)), F.coalesce(keys, F.array().cast("array<string>"))))
    blank = lambda c: F.coalesce(T.strip(row[c]) == "", F.lit(True))
    return first_failure(
        [
            (error.isNotNull(), "not_object"),
            (F.size(missing) > 0, "missing_fields"),
            (~F.coalesce(row["task_type"].isin(*K.TASK_TYPES), F.lit(False)), "invalid_task_type"),
            (F.coalesce(row["language"] != "en", F.lit(True)), "invalid_language"),
            (blank("instruction"), "empty_instruction"),
            (row["input"].isNull(), "invalid_input"),
            (blank("output"), "empty_output"),
            (~metadata_is_object, "invalid_metadata"),
        ]
    )


def content(instruction: Column, given: Column, output: Column, output_words: Column, replay: Column | None = None, keep_low_diversity: bool = False) -> Column:
    """Content filters in order; ``output_words`` are the output's lower-case words, computed once."""
    replay = F.lit(False) if replay is None else replay
    ratio = T.unique_ratio(output_words)
    whole = F.concat_ws("\n", instruction, given, output)
    low = F.when(replay, ratio < (K.UNIQUE_EXTREME if keep_low_diversity else K.UNIQUE_REPLAY)).otherwise(ratio < K.UNIQUE_NORMAL)
    name = F.when(replay, F.lit("extremely_low_unique_word_ratio" if keep_low_diversity else "low_unique_word_ratio")).otherwise("low_unique_word_ratio")
    return F.coalesce(
        F.when(~replay & (T.word_count(instruction) < K.LEAST_INSTRUCTION_WORDS), F.lit("instruction_too_short")),
        F.when(F.size(output_words) < K.LEAST_OUTPUT_WORDS, F.lit("output_too_short")),
        F.when(~T.printable_ascii_ok(whole), F.lit("not_english_printable")),
        F.when(T.repeated_sentence(output), F.lit("repeated_sentence")),
        F.when(low, name),
        F.when(T.obvious_loop(output_words), F.lit("obvious_loop")),
    )


def score_pass(scores: Column) -> Column:
    """No scores pass; else safety, where given, must be 5, and the mean 4 or more; an empty map fails."""
    mean = F.aggregate(F.map_values(scores), F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(scores), F.lit(0))
    safe = F.coalesce(F.try_element_at(scores, F.lit("safety")) == K.SAFETY_PASS, F.lit(True))
    return F.when(scores.isNull(), True).otherwise(safe & F.coalesce(mean >= K.SCORE_PASS, F.lit(False)))
