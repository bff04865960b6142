"""Replay rows: stories as writing and continuation examples, with a reason for each that is left out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..session import stored
from . import sampling

MODES = ("story_writing", "story_continuation", "mixed")


@dataclass(frozen=True)
class ReplayOptions:
    mode: str = "mixed"
    min_words: int = 40
    max_words: int = 140
    unique_instructions: bool = False
    max_seq_len: int = 512
    seed: int = 1337

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if not 0 < self.min_words <= self.max_words:
            raise ValueError("min_words must be positive and max_words no less")


def chosen(n: int, seed: int, what: str, id: Column) -> Column:
    """A number below ``n`` by hash."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(what), id.cast("string")).cast("binary")), 1, 4), 16, 10).cast("int") % n


def replay_rows(stories: DataFrame, options: ReplayOptions = ReplayOptions(), tokens: Column | None = None) -> DataFrame:
    """id, task_type, instruction, input, output, reason of what becomes of each story (id, story), in one pass.

    A story is a writing row, and if it has three sentences or more a continuation row of its first sentence (or two,
    where it has five or more).  ``reason`` is null for candidates, else short, long, unclean or token_too_long; a story
    that isn't clean (two sentences at least, each with a capital or digit first, the last with a mark) gives one
    unclean row, without a task.  White space counts as one space; blank and null stories give nothing.  ``tokens``
    counts a row's tokens from instruction, input and output, by default their words.
    """
    # step by step, else each use of the story and its sentences would search the text again
    found = stories.select("id", "story").where(F.coalesce(T.strip(F.col("story")), F.lit("")) != "")
    whole = found.select("id", T.normalize_display(F.col("story")).alias("story"))
    parts = whole.select("id", "story", T.split_sentences(F.col("story")).alias("s"))
    cut = parts.select("id", "story", "s", F.coalesce(T.is_clean_story_span(F.col("story"), F.col("s")), F.lit(False)).alias("clean"))
    n = F.size("s")
    first = F.when(n <= 4, 1).otherwise(1 + chosen(2, options.seed, "prefix", F.col("id")))
    pick = lambda names, what: F.element_at(F.array(*map(F.lit, names)), chosen(len(names), options.seed, what, F.col("id")) + 1)
    note = lambda text, kind: F.concat(text, F.lit(f" Replay {kind} "), F.col("id").cast("string"), F.lit(".")) if options.unique_instructions else text
    built = lambda task, instruction, given, output: F.struct(F.lit(task).alias("task_type"), instruction.alias("instruction"), given.alias("input"), output.alias("output"))
    writing = built("story_writing", note(pick(K.STORY_INSTRUCTIONS, "story"), "story"), F.lit(""), F.col("story"))
    going_on = built("story_continuation", note(pick(K.CONTINUATION_INSTRUCTIONS, "continuation"), "continuation"), F.array_join(F.slice("s", F.lit(1), first), " "), F.array_join(F.slice("s", first + 1, n), " "))
    unclean = F.struct(F.lit(None).cast("string").alias("task_type"), F.lit("").alias("instruction"), F.lit("").alias("input"), F.col("story").alias("output"))
    rows = [F.when(~F.col("clean"), unclean)]
    if options.mode != "story_continuation":
        rows.append(F.when(F.col("clean"), writing))
    if options.mode != "story_writing":
        rows.append(F.when(F.col("clean") & (n >= 3), going_on))
    spread = cut.select("id", F.explode(F.array_compact(F.array(*rows))).alias("x")).select("id", "x.*")
    # what goes on is clean too: of a clean story the sentences after the first, or of five or more after the second, two at least
    def judged(words: Column) -> Column:
        count = T.word_count(F.col("instruction")) + T.word_count(F.col("input")) + words if tokens is None else tokens
        return F.when(words < options.min_words, "short").when(words > options.max_words, "long").when(count > options.max_seq_len, "token_too_long")

    reason = F.when(F.col("task_type").isNull(), "unclean").otherwise(T.once(T.word_count(F.col("output")), judged))
    return spread.withColumn("reason", reason)


def selected(rows: DataFrame, count: int, seed: int = 1337, source: str = "tinystories_replay") -> DataFrame:
    """new_id, place and the first ``count`` candidates of ``replay_rows`` in hash order."""
    candidates = rows.where("reason IS NULL").withColumn("_key", F.concat_ws(":", F.col("id").cast("string"), "task_type")).withColumn("_all", F.lit(""))
    # stored, as ranks are found in several passes, of which only the last needs the texts, and those of the first parts alone
    candidates = stored(candidates.withColumn("_order", sampling.hash_order(seed, "_key")))
    first = sampling.hash_head(candidates, F.col("_order"), max(0, count))
    ranked = sampling.hash_rank(first, "_all", F.col("_order"), "_key", "place").where(F.col("place") <= max(0, count))
    new_id = F.concat(F.lit(f"{source}_"), F.when(F.col("place") < 1_000_000, F.lpad(F.col("place").cast("string"), 6, "0")).otherwise(F.col("place").cast("string")))
    return ranked.select(new_id.alias("new_id"), "place", "id", "task_type", "instruction", "input", "output")


def replay_manifest(rows: DataFrame) -> DataFrame:
    """task_type, reason, n of all rows: candidates have no reason."""
    return rows.groupBy("task_type", "reason").agg(F.count("*").alias("n"))
