"""Queries over story replay rows, repair packs and acceptance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import constants as K
from ..functions import text as T
from ..operators import factory, replay, teacher
from .instruction import _TEACHER, NAME, _early_sql, _list, _teacher_rows

OPTIONS = replay.ReplayOptions(min_words=10, max_words=60, max_seq_len=75)
LINES = 1_000_000
_CHOSEN = "('0x' || substr(md5('{seed}:{what}:' || id), 1, 4))::INTEGER % {n}"


def _chosen(what: str, n: int) -> str:
    return _CHOSEN.format(seed=OPTIONS.seed, what=what, n=n)


def _clean(x: str, s: str) -> str:
    return rf"(regexp_matches({x}, '[.!?]$') AND len({s}) >= 2 AND len(list_filter({s}, lambda v: NOT regexp_matches(v, '^[\p{{Lu}}\p{{Nd}}]'))) = 0)"


def _sentences(x: str) -> str:
    return rf"list_filter(string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda v: v <> '')"


_REPLAY = rf"""
WITH stories AS (SELECT doc_id * {LINES} + i AS id, regexp_replace(regexp_replace(line, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS story FROM (
  SELECT doc_id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS line FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '\r\n|[\r\n]') AS l FROM documents))),
cut AS (SELECT *, {_sentences('story')} AS s FROM stories WHERE story <> ''),
known AS (SELECT *, {_clean('story', 's')} AS clean, CASE WHEN len(s) <= 4 THEN 1 ELSE 1 + {_chosen('prefix', 2)} END AS first FROM cut),
rows AS (
  SELECT id, NULL AS task_type, '' AS instruction, '' AS input, story AS output FROM known WHERE NOT clean
  UNION ALL SELECT id, 'story_writing', {_list(K.STORY_INSTRUCTIONS)}[{_chosen('story', len(K.STORY_INSTRUCTIONS))} + 1], '', story FROM known WHERE clean
  UNION ALL SELECT id, 'story_continuation', {_list(K.CONTINUATION_INSTRUCTIONS)}[{_chosen('continuation', len(K.CONTINUATION_INSTRUCTIONS))} + 1], array_to_string(s[1:first], ' '), array_to_string(s[first + 1:], ' ') FROM known WHERE clean AND len(s) >= 3),
counted AS (SELECT *, len(regexp_extract_all(output, '{K.WORD.replace("'", "''")}')) AS n, len(regexp_extract_all(instruction || ' ' || input, '{K.WORD.replace("'", "''")}')) AS asked, {_sentences('output')} AS s FROM rows),
judged AS (SELECT *, CASE WHEN task_type IS NULL THEN 'unclean' WHEN n < {OPTIONS.min_words} THEN 'short' WHEN n > {OPTIONS.max_words} THEN 'long' WHEN NOT {_clean('output', 's')} THEN 'unclean'
  WHEN n + asked > {OPTIONS.max_seq_len} THEN 'token_too_long' END AS reason FROM counted)
"""


def _stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r\n|[\r\n]")).alias("i", "story"))
    return lines.select((F.col("doc_id") * LINES + F.col("i")).alias("id"), "story")


@query(f"{_REPLAY} SELECT id, task_type, instruction, md5(input) AS input, md5(output) AS output, reason FROM judged")
def story_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of the documents as a story: its writing and continuation rows, and why each is left out."""
    found = replay.replay_rows(_stories(spark, sf_dir), OPTIONS)
    return found.select("id", "task_type", "instruction", F.md5("input").alias("input"), F.md5("output").alias("output"), "reason")


@query(f"""{_REPLAY},
ranked AS (SELECT *, row_number() OVER (ORDER BY md5('{OPTIONS.seed}:' || id || ':' || task_type), id || ':' || task_type) AS place FROM judged WHERE reason IS NULL)
SELECT 'tinystories_replay_' || lpad(place::VARCHAR, 6, '0') AS new_id, place, id, task_type, md5(output) AS output FROM ranked WHERE place <= 500""")
def story_replay_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 candidates in hash order, under their new ids."""
    found = replay.selected(replay.replay_rows(_stories(spark, sf_dir), OPTIONS), 500, OPTIONS.seed)
    return found.select("new_id", "place", "id", "task_type", F.md5("output").alias("output"))


@query(f"{_REPLAY} SELECT task_type, reason, count(*) AS n FROM judged GROUP BY ALL")
def story_replay_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.replay_manifest(replay.replay_rows(_stories(spark, sf_dir), OPTIONS))


SHARDS, MOST = 6, 40
_REJECTED = f"SELECT id AS place, id % {SHARDS} AS shard, 's' || (doc_id // 2) AS seed_id, category, {_early_sql('strict')} AS reason FROM ({_TEACHER})"


def _rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teacher rows dealt over shards, with the rule that each fails, or null.

    The rule comes out of a generator, as a filter on it would otherwise be pushed below and all rules evaluated again for it.
    """
    rows = _teacher_rows(spark, sf_dir)
    row = {c: F.col(c) for c in rows.columns}
    reason = teacher.early_failure(row, F.col("words"), "strict", NAME)
    worded = rows.withColumn("words", T.words(T.strip(F.col("output"))))
    return worded.select(F.col("id").alias("place"), (F.col("id") % SHARDS).alias("shard"), F.concat(F.lit("s"), F.floor(F.col("id") / 4).cast("string")).alias("seed_id"), "category", F.explode(F.array(reason)).alias("reason"))


@query(f"""
WITH r AS ({_REJECTED}), f AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY place) AS n FROM r WHERE reason IS NOT NULL),
k AS (SELECT *, dense_rank() OVER (ORDER BY shard) AS i FROM f WHERE n <= {MOST}),
s AS (SELECT 's' || doc_id AS seed_id, lang || ' ' || source AS seed FROM documents WHERE doc_id % 3 > 0)
SELECT 'repair_2_' || lpad(i::VARCHAR, 4, '0') || '_' || lpad(n::VARCHAR, 3, '0') AS repair_id, 'repair_shard_' || lpad(i::VARCHAR, 4, '0') AS repair_shard, shard, place, k.seed_id, category, reason, seed,
  CASE reason {" ".join(f"WHEN '{k}' THEN '" + v.format(name=NAME).replace("'", "''") + "'" for k, v in K.REPAIR_HINTS.items())} ELSE 'Fix rejection `' || reason || '` for category `' || category || '`.' END AS hint
FROM k LEFT JOIN s ON k.seed_id = s.seed_id""")
def repair_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 rejected teacher rows of each shard with their seeds (a third has none) and what to do about each."""
    rejected = _rejected(spark, sf_dir).where("reason IS NOT NULL")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 3 > 0")
    seeds = docs.select(F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("seed_id"), F.concat_ws(" ", "lang", "source").alias("seed"), F.col("doc_id").alias("ord"))
    return factory.repair_rows(rejected, seeds, MOST, 2, NAME).select("repair_id", "repair_shard", "shard", "place", "seed_id", "category", "reason", "seed", "hint")


@query(f"SELECT reason, count(*) AS n FROM ({_REJECTED}) WHERE reason IS NOT NULL GROUP BY reason")
def unresolved_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factory.unresolved(_rejected(spark, sf_dir).where("reason IS NOT NULL"))


@query(f"""
WITH c AS (SELECT category, shard, count_if(reason IS NULL) AS a, count_if(reason IS NOT NULL) AS r FROM ({_REJECTED}) GROUP BY ALL)
SELECT category, sum(a)::BIGINT AS accepted, sum(r)::BIGINT AS rejected, sum(a + r)::BIGINT AS total, round(sum(a) / sum(a + r), 4) AS rate, round(min(a / (a + r)), 4) AS worst_shard, sum(a) / sum(a + r) >= 0.5 AS healthy FROM c GROUP BY category""")
def acceptance_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each category, how many rows of all shards pass the strict checks, and the worst shard."""
    counts = _rejected(spark, sf_dir).groupBy("category", "shard").agg(F.count_if(F.col("reason").isNull()).alias("accepted"), F.count_if(F.col("reason").isNotNull()).alias("rejected"))
    return factory.acceptance(counts, ["category"])
