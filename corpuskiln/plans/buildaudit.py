"""Queries of a build audit: documents as raw rows, of which the factory accepted some and a filter rejected some."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import _KEY, _WORD, query
from ..functions import constants as K
from ..operators.buildaudit import BuildAudit
from .instruction import _list, _pick

SOURCE = "audited"
TASKS = ["simple_qa", "summarization", "dialogue", "simple_reasoning", "story_writing"]
CATEGORIES = ["safety_refusal", "identity_chat", "simple_qa", "poems", "story_request", "summarization", "none"]
_ROWS = f"""
WITH raw AS (SELECT doc_id, 'r' || (doc_id % 900) AS row_id, CASE WHEN doc_id % 4 = 0 THEN source ELSE '{SOURCE}' END AS source, {_list(TASKS)}[(doc_id % {len(TASKS)} + 1)::INT] AS task_type,
  {_list(CATEGORIES)}[(doc_id % {len(CATEGORIES)} + 1)::INT] AS category, 'Write in ' || lang AS instruction, coalesce(text, '') AS output, n_chars, {_KEY.replace('text', "coalesce(text, '')")} AS k FROM documents),
accepted AS (SELECT * FROM raw WHERE doc_id % 3 > 0), rejected AS (SELECT *, CASE WHEN n_chars < 600 THEN 'filtered' ELSE 'duplicates' END AS bucket, CASE WHEN n_chars < 600 THEN 'output_too_short' END AS reason FROM raw WHERE n_chars < 600 OR doc_id % 5 = 1),
own AS (SELECT * FROM rejected WHERE source = '{SOURCE}')
"""


def _audit(spark: SparkSession, sf_dir: str) -> BuildAudit:
    n, docs = F.col("doc_id"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    raw = docs.select(n.alias("ord"), F.concat(F.lit("r"), (n % 900).cast("string")).alias("row_id"), F.when(n % 4 == 0, F.col("source")).otherwise(SOURCE).alias("source"), _pick(TASKS, n % len(TASKS)).alias("task_type"), _pick(CATEGORIES, n % len(CATEGORIES)).alias("category"), F.concat(F.lit("Write in "), "lang").alias("instruction"), F.lit("").alias("input"), F.coalesce("text", F.lit("")).alias("output"), "n_chars")
    short = F.col("n_chars") < 600
    rejected = raw.where(short | (F.col("ord") % 5 == 1)).withColumns({"bucket": F.when(short, "filtered").otherwise("duplicates"), "reason": F.when(short, "output_too_short")})
    return BuildAudit(raw, raw.where(F.col("ord") % 3 > 0), rejected, SOURCE)


_COUNTS = " UNION ALL ".join(
    f"SELECT '{part}' AS part, '{dim}' AS dim, coalesce({dim}, 'UNKNOWN') AS key, count(*) AS n FROM {table} GROUP BY 3"
    for part, table, dims in (("raw", "raw", ("source", "task_type")), ("factory_accepted", "accepted", ("source", "task_type", "category")), ("rejected", "rejected", ("bucket",)), ("own_rejected", "own", ("task_type", "category")))
    for dim in dims
)


@query(f"{_ROWS} {_COUNTS}")
def build_audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw, accepted and rejected rows by source, task type, category and bucket."""
    return _audit(spark, sf_dir).counts()


@query(f"""{_ROWS},
a AS (SELECT DISTINCT source, task_type, instruction, k FROM accepted), o AS (SELECT DISTINCT source, task_type, instruction, k FROM own)
SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM o)) AS accepted_and_rejected, (SELECT count(*) FROM (SELECT DISTINCT row_id FROM accepted INTERSECT SELECT DISTINCT row_id FROM own)) AS accepted_and_rejected_by_id,
  (SELECT count(DISTINCT row_id) FROM own) AS rejected_ids, (SELECT count(*) = 0 FROM (SELECT * FROM o EXCEPT SELECT * FROM a)) AS all_rejected_were_accepted""")
def build_audit_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was accepted by the factory and rejected by the build, by content and by id."""
    return _audit(spark, sf_dir).overlap()


_SHOWN = r"regexp_replace(regexp_replace({}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"
_MAPS = f"""{_ROWS}, keyed AS (SELECT *, lower(instruction) AS ik, {_SHOWN.format("output")} AS shown FROM accepted),
maps AS (
  SELECT 'instruction_only' AS map, ik AS key, instruction AS display, doc_id FROM keyed UNION ALL SELECT 'output_only', k, shown, doc_id FROM keyed
  UNION ALL SELECT 'instruction_output_pair', trim(ik || ' ' || k), instruction || ' || ' || shown, doc_id FROM keyed
  UNION ALL SELECT 'output_within_task_type', trim(task_type || ' ' || k), task_type || ' :: ' || shown, doc_id FROM keyed UNION ALL SELECT 'output_across_all_tasks', k, shown, doc_id FROM keyed),
found AS (SELECT map, arg_min(display, doc_id) AS display, count(*) AS n FROM maps WHERE key <> '' GROUP BY map, key HAVING count(*) > 1)
"""


@query(f"{_MAPS} SELECT map, md5(display) AS display, n FROM found")
def duplicate_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions, outputs, pairs and outputs by task that occur more than once among the accepted rows."""
    return _audit(spark, sf_dir).duplicates().select("map", F.md5("display").alias("display"), "n")


@query(f"""{_ROWS}, each AS (SELECT doc_id, task_type AS key, 0 AS side FROM accepted UNION SELECT doc_id, category, 0 FROM accepted UNION SELECT doc_id, task_type, 1 FROM own UNION SELECT doc_id, category, 1 FROM own)
SELECT key, count_if(side = 0)::BIGINT AS factory_accepted, count_if(side = 1)::BIGINT AS build_rejected FROM each WHERE key IN ({", ".join(f"'{t}'" for t in K.TARGET_CATEGORIES)}) GROUP BY key""")
def destroyed_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted and rejected rows of each target task type or category."""
    return _audit(spark, sf_dir).losses()


_LENGTHS = """SELECT '{part}' AS part, task_type, field, min(n)::BIGINT AS least, floor(median(n))::BIGINT AS median, list_sort(list(n))[floor(0.9 * (count(*) - 1))::BIGINT + 1]::BIGINT AS p90 FROM (
  SELECT task_type, 'instruction_words' AS field, len(regexp_extract_all(instruction, '{word}')) AS n FROM {table} UNION ALL SELECT task_type, 'output_words', len(regexp_extract_all(output, '{word}')) FROM {table}) GROUP BY task_type, field"""


@query(f"""{_ROWS}, kept AS (SELECT * FROM raw r WHERE source = '{SOURCE}' AND NOT EXISTS (SELECT 1 FROM own o WHERE o.task_type = r.task_type AND o.instruction = r.instruction AND o.k = r.k))
{_LENGTHS.format(part="kept", word=_WORD, table="kept")} UNION ALL {_LENGTHS.format(part="rejected", word=_WORD, table="own")}""")
def build_audit_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the audited source's rows that the build kept and rejected."""
    audit = _audit(spark, sf_dir)
    return audit.kept_lengths().select(F.lit("kept").alias("part"), "*").unionByName(audit.rejected_lengths().select(F.lit("rejected").alias("part"), "*"))


@query(f"""{_ROWS}, named AS (SELECT *, coalesce(reason, bucket) AS why FROM own)
SELECT why AS reason, row_id, task_type, category, md5(output) AS output FROM named QUALIFY row_number() OVER (PARTITION BY why ORDER BY md5('1337:' || why || ':' || doc_id), doc_id) <= 10""")
def build_audit_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rejected rows of each reason."""
    return _audit(spark, sf_dir).sampled().select("reason", "row_id", "task_type", "category", F.md5("output").alias("output"))


@query(f"""{_MAPS}, sums AS (SELECT (SELECT count(*) FROM accepted) AS accepted, (SELECT count(*) FROM own) AS rejected,
  coalesce(sum(n) FILTER (map = 'instruction_output_pair'), 0)::BIGINT AS pair_copies, coalesce(sum(n) FILTER (map = 'output_across_all_tasks'), 0)::BIGINT AS output_copies FROM found)
SELECT *, CASE WHEN rejected = 0 THEN 'Mixed evidence' WHEN rejected / greatest(1, accepted) > 0.5 AND pair_copies < rejected * 0.25 THEN 'Evidence suggests build filter is over-aggressive'
  WHEN pair_copies > rejected * 0.5 OR output_copies > accepted THEN 'Evidence suggests data is bad' ELSE 'Mixed evidence' END AS conclusion FROM sums""")
def build_audit_conclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit(spark, sf_dir).conclusion()


@query(f"""{_ROWS}, keyed AS (SELECT *, {_SHOWN.format("output")} AS shown FROM accepted WHERE k <> ''),
top AS (SELECT k, count(*) AS n, arg_min(shown, doc_id) AS display FROM keyed GROUP BY k HAVING count(*) > 1 ORDER BY n DESC, display LIMIT 10)
SELECT row_number() OVER (ORDER BY t.n DESC, t.display)::INTEGER AS place, md5(t.display) AS display, t.n, (SELECT string_agg(row_id, ',' ORDER BY doc_id) FROM (SELECT row_id, doc_id FROM keyed x WHERE x.k = t.k ORDER BY doc_id LIMIT 3)) AS first_ids,
  (SELECT count(DISTINCT task_type) FROM keyed x WHERE x.k = t.k)::INTEGER AS task_types, (SELECT count(DISTINCT category) FROM keyed x WHERE x.k = t.k)::INTEGER AS categories FROM top t""")
def duplicate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest groups of equal outputs among the accepted rows."""
    found = _audit(spark, sf_dir).clusters()
    return found.select("place", F.md5("display").alias("display"), "n", F.array_join("first_ids", ",").alias("first_ids"), F.size("task_types").alias("task_types"), F.size("categories").alias("categories"))
