"""Composite operators: build splits from raw rows, mix sources, merge shards and accepted rows, repair packs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..session import ensure_checkpoint_dir, stored
from . import dedup, rules, sampling


@dataclass(frozen=True)
class BuildOptions:
    val_ratio: float = 0.02
    seed: int = 1337
    max_seq_len: int = 512
    replay_prefix: str = "tinystories_replay"
    keep_replay_duplicates: bool = False
    replay_dedup: bool = True
    keep_low_diversity: bool = False
    trusted_prefixes: tuple[str, ...] = ()


def scored_row(keys: Column, scores_kind: Column, values_are_numbers: Column, judge_kind: Column, error: Column) -> Column:
    """The first rule that a score row breaks: its fields, then the kinds of scores, their values and the judge."""
    missing = lambda f: ~F.coalesce(F.array_contains(keys, f), F.lit(False))
    absent = F.lit(False)
    for f in ("id", "example_id", "scores", "judge"):
        absent = absent | missing(f)
    is_object = lambda kind: F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    return rules.first_failure(
        [
            (error.isNotNull(), "not_object"),
            (absent, "missing_fields"),
            (~is_object(scores_kind), "invalid_scores"),
            (~F.coalesce(values_are_numbers, F.lit(False)), "invalid_score_value"),
            (~is_object(judge_kind), "invalid_judge"),
        ]
    )


def word_budget(instruction: Column, given: Column, output: Column) -> Column:
    """Tokens of a sample where no tokenizer is given: its words."""
    return T.word_count(instruction) + T.word_count(F.coalesce(given, F.lit(""))) + T.word_count(output)


def build(rows: DataFrame, scores: DataFrame, options: BuildOptions = BuildOptions(), tokens: Column | None = None) -> DataFrame:
    """id (the order), bucket (accepted, malformed, too_long, filtered, duplicates), reason and split (train, val, or null) of every row.

    ``rows`` has id (a number), row_id, source, task_type, instruction, input, output and structural (the reason of the
    structural check, or null); ``scores`` has example_id, scores and ord (of equal ids the last counts).  ``tokens``
    counts a row's tokens, its words by default.  Checks run in this order: structure, length, content (trusted sources
    are spared), duplicates of accepted rows, scores; a row that its scores reject makes no duplicates.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    latest = scores.groupBy("example_id").agg(F.max_by("scores", "ord").alias("scores"))
    source = F.coalesce("source", F.lit(""))
    replay = source.startswith(options.replay_prefix)
    trusted = F.lit(False)
    for prefix in options.trusted_prefixes:
        trusted = trusted | source.startswith(prefix)
    count = word_budget(F.col("instruction"), F.col("input"), F.col("output")) if tokens is None else tokens
    worded = rows.withColumns({"words": T.words(F.coalesce("output", F.lit(""))), "trusted": trusted, "replay": replay})
    content = rules.content(F.col("instruction"), F.col("input"), F.col("output"), F.col("words"), F.col("replay"), options.keep_low_diversity)
    bucket = F.when(F.col("structural").isNotNull(), F.struct(F.lit("malformed").alias("bucket"), F.col("structural").alias("reason")))
    bucket = bucket.when(~F.coalesce(F.col("count").between(1, options.max_seq_len), F.lit(False)), F.struct(F.lit("too_long").alias("bucket"), F.lit("too_long").alias("reason")))
    bucket = bucket.when(F.col("content").isNotNull(), F.struct(F.lit("filtered").alias("bucket"), F.col("content").alias("reason")))
    alpha = T.alpha_tokens(F.col("instruction"))
    free = F.col("replay") & F.lit(options.keep_replay_duplicates)
    keys = {
        "pair": F.when(~free, T.pair_hash(F.col("instruction"), F.col("output"))),
        "own_id": F.when(~free & F.col("trusted"), F.col("row_id")),
        "asked": F.when(~free & ~F.col("trusted") & (F.size(alpha) >= 4), T.token_key(F.col("instruction"))),
        "story": F.when(free & F.lit(options.replay_dedup), T.output_hash(F.col("output"))),
    }
    # step by step: what the content's rules cost is spent once, and keys are made of rows that come so far
    sound = F.col("structural").isNull() & F.coalesce(F.col("count").between(1, options.max_seq_len), F.lit(False))
    judged = worded.withColumn("count", count).withColumn("content", F.when(sound & ~F.col("trusted"), content)).withColumn("early", bucket)
    kept = judged.select("id", "row_id", "source", "task_type", "early", *[F.when(F.col("early").isNull(), v).alias(k) for k, v in keys.items()])
    joined = kept.join(latest, kept["row_id"] == latest["example_id"], "left")
    checked = joined.select("id", "row_id", "source", "task_type", "early", *keys, rules.score_pass(F.col("scores")).alias("passed")).checkpoint()
    reached = checked.where("early IS NULL")
    # replay outputs count from the first row that came so far, accepted or not
    first = reached.where("story IS NOT NULL").groupBy("story").agg(F.min("id").alias("first"))
    once = reached.join(first, "story", "left").withColumn("retold", F.coalesce(F.col("first") < F.col("id"), F.lit(False)))
    settled = dedup.greedy(once.select("id", (~F.col("passed") | F.col("retold")).alias("blocked"), "pair", "own_id", "asked"), ["pair", "own_id", "asked"])
    found = checked.join(once.select("id", "retold"), "id", "left").join(settled.select("id", "state"), "id", "left")
    late = F.when((F.col("state") == "duplicate") | F.col("retold"), F.struct(F.lit("duplicates").alias("bucket"), F.lit("duplicate").alias("reason")))
    late = late.when(~F.col("passed"), F.struct(F.lit("filtered").alias("bucket"), F.lit("score_filtered").alias("reason")))
    out = found.select("id", "source", "task_type", F.coalesce("early", late, F.struct(F.lit("accepted").alias("bucket"), F.lit(None).cast("string").alias("reason"))).alias("x")).select("id", "source", "task_type", "x.*").checkpoint()
    split = sampling.stratified_split(out.where("bucket = 'accepted'").select("id", "task_type"), "task_type", "id", options.val_ratio, options.seed)
    return out.join(split.select("id", "split"), "id", "left")


def manifest(built: DataFrame, by: list[str]) -> DataFrame:
    """dim, key, bucket, n: rows of each bucket by every column of ``by``, in one pass."""
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("dim"), F.coalesce(F.col(c).cast("string"), F.lit("UNKNOWN")).alias("key")) for c in by]))
    return built.select("bucket", stacked.alias("x")).groupBy("x.dim", "x.key", "bucket").agg(F.count("*").alias("n"))


def split_categories(built: DataFrame, category: str) -> DataFrame:
    """category, train, val, total of accepted rows of known task types."""
    known = built.where(F.col("split").isNotNull() & F.col(category).isin(*K.TASK_TYPES))
    return known.groupBy(F.col(category).alias("category")).agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "val").alias("val"), F.count("*").alias("total"))


def mix(rows: DataFrame, caps: dict[str, tuple[int | None, int | None]], seed: int) -> DataFrame:
    """Rows (key, name, rank, task, instruction, output) of several sources as one set: new_id, name, original_id, task, position.

    ``caps`` gives each source's caps (of a task, of all); ``rank`` is the source's place.  Rows are taken in hash order,
    numbered before duplicates of earlier sources go (so numbers have gaps), and shuffled at the end.
    """
    order = sampling.hash_order(seed, "name", "key")
    taken = None
    for name, (task_cap, cap) in caps.items():
        part = sampling.capped(rows.where(F.col("name") == name), "name", "task", task_cap, cap, seed, "key")
        taken = part if taken is None else taken.unionByName(part)
    numbered = sampling.hash_rank(taken.withColumn("_o", order), "name", F.col("_o"), "key", "number")
    first = Window.partitionBy(T.pair_hash(F.col("instruction"), F.col("output"))).orderBy("rank", "number")
    once = numbered.withColumn("_first", F.row_number().over(first)).where("_first = 1")
    named = once.select(F.concat_ws("_", "name", F.lpad(F.col("number").cast("string"), 6, "0")).alias("new_id"), "name", F.col("key").alias("original_id"), "task")
    whole = sampling.hash_rank(named.withColumn("_all", F.lit("")), "_all", sampling.hash_order(seed, "new_id"), "new_id", "position")
    return whole.drop("_all")


def merge_shards(rows: DataFrame) -> DataFrame:
    """Rows (file, line, row_id, reason: of the structural check) with reason duplicate_id for all but an id's first, and the sort keys number and row_id."""
    sound = F.col("reason").isNull()
    first = Window.partitionBy("row_id", sound).orderBy("file", "line")
    again = sound & (F.row_number().over(first) > 1)
    return rows.withColumn("reason", F.when(again, "duplicate_id").otherwise(F.col("reason"))).withColumn("number", T.trailing_number(F.col("row_id")))


def merge_accepted(rows: DataFrame) -> DataFrame:
    """Accepted rows (round, file, line, instruction, output, ...) without later copies: initial ones first, then rounds by name."""
    rank = F.when(F.col("round") == "initial", "").otherwise(F.col("round"))
    first = Window.partitionBy(T.pair_hash(F.col("instruction"), F.col("output"))).orderBy(rank, "file", "line")
    return rows.withColumn("_first", F.row_number().over(first)).where("_first = 1").drop("_first")


def merge_advice(merged: Column) -> Column:
    """What to do next with so many accepted rows."""
    return F.when(merged >= 800, "mix").when(merged >= 500, "one_more_round").otherwise("do_not_train")


def repair_pack(rejected: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """repair_index, place and the rejected row (shard, place, seed_id, ...) with its seed: the first ``most`` of each shard; shards are numbered without gaps."""
    known = seeds.groupBy("seed_id").agg(F.min_by("seed", "ord").alias("seed"))
    # stored, else the rows would be judged again for the shards' numbers
    first = stored(rejected.withColumn("_n", F.row_number().over(Window.partitionBy("shard").orderBy("place"))).where(F.col("_n") <= most).drop("_n"))
    shards = first.select("shard").distinct().withColumn("repair_index", F.row_number().over(Window.orderBy("shard")))  # a row for each shard
    return first.join(shards, "shard").join(known, "seed_id", "left")


def templated(rows: DataFrame, least: int = 5) -> DataFrame:
    """id, reason of rows (id, words: in lower case) that look templated: few different words, or an opening that ``least`` rows share."""
    head = F.array_join(F.slice("words", 1, 3), " ")
    openings = rows.where(F.size("words") > 0).groupBy(head.alias("opening")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    low = (F.size("words") >= 20) & (T.unique_ratio(F.col("words")) < 0.32)
    joined = rows.withColumn("opening", F.when(F.size("words") > 0, head)).join(openings, "opening", "left")
    return joined.select("id", F.when(low, "low_unique_word_ratio").when(F.col("n").isNotNull(), "common_output_opening").alias("reason")).where("reason IS NOT NULL")


def allocate(count: int, targets: dict[str, int]) -> dict[str, int]:
    """``count`` dealt out in the proportion of ``targets``, by largest remainder (of equal ones the larger target first)."""
    whole = sum(targets.values())
    exact = {k: count * v / whole for k, v in targets.items()}
    out = {k: int(x) for k, x in exact.items()}
    for k in sorted(targets, key=lambda k: (exact[k] - out[k], targets[k]), reverse=True)[: count - sum(out.values())]:
        out[k] += 1
    return out


def tail_split(n: int, block: int, fraction: float) -> int:
    """How many of ``n`` tokens, the last ones, are kept for validation."""
    wanted = max(block + 2, int(n * fraction))
    if n - wanted <= block + 1:
        wanted = max(1, min(n // 5, n - block - 2))
    if wanted <= block + 1 or n - wanted <= block + 1:
        raise ValueError("too few tokens for a block of each split")
    return wanted


def repeats(n: int, block: int) -> int:
    """How many times ``n`` tokens are repeated so that both splits have a block."""
    least = 2 * (block + 2) + 1
    return max(1, -(-least // n)) if n else 0
