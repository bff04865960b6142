"""All queries of the engine by name, and the SQL for each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import constants as K
from .functions import text as T
from .operators import dedup, evaluation, overlap, profile, rules, sampling, tokens
from .session import ensure_checkpoint_dir

INSTRUCTION = "Write one more text like this"
SEED = 1337
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_KEY = r"regexp_replace(lower(" + _STRIP.format("text") + r"), '\s+', ' ', 'g')"
_WORD = K.WORD.replace("'", "''")
_WORDS = f"regexp_extract_all(lower(text), '{_WORD}')"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _grams_sql(n: int) -> str:
    return f"list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' '))"


def _reasons(docs: DataFrame) -> DataFrame:
    worded = docs.select("*", T.words(F.col("text")).alias("w"))
    return worded.withColumn("reason", rules.content(F.lit(INSTRUCTION), F.lit(""), F.col("text"), F.col("w")))


_PRINT = r"length(regexp_replace(x, '[^\x20-\x7E\t\n\r\x0B\x0C\x1C-\x1F\x{85}\p{Z}]', '', 'g')) / length(x)"
_LOOP = " OR ".join(f"coalesce(list_max(map_values(list_aggregate({_grams_sql(n)}, 'histogram'))), 0) >= 5" for n in (2, 3, 4))
_REASONS = rf"""
SELECT *, CASE
  WHEN len(w) < 20 THEN 'output_too_short'
  WHEN NOT ({_PRINT} >= 0.98 AND length(regexp_replace(x, '[^\x00-\x7F]', '', 'g')) / length(x) >= 0.9) THEN 'not_english_printable'
  WHEN len(s) <> len(list_distinct(s)) THEN 'repeated_sentence'
  WHEN len(list_distinct(w)) / len(w) < 0.25 THEN 'low_unique_word_ratio'
  WHEN {_LOOP} THEN 'obvious_loop' END AS reason
FROM (SELECT *, {_WORDS} AS w, '{INSTRUCTION}' || chr(10) || chr(10) || text AS x,
  list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda v: lower({_STRIP.format('v')})), lambda v: v <> '') AS s FROM documents)
"""


@query(f"SELECT coalesce(reason, 'ok') AS reason, count(*) AS n FROM ({_REASONS}) GROUP BY 1")
def quality_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each content filter rejects first."""
    return _reasons(_docs(spark, sf_dir)).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"SELECT source, coalesce(reason, 'ok') AS bucket, count(*) AS n FROM ({_REASONS}) GROUP BY 1, 2")
def reasons_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reasons(_docs(spark, sf_dir)).groupBy("source", F.coalesce("reason", F.lit("ok")).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, row_number() OVER (PARTITION BY {_KEY} ORDER BY doc_id) = 1 AS kept, sha256({_KEY}) AS key_hash FROM documents")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each normalised text."""
    hashed = _docs(spark, sf_dir).select("doc_id", T.output_hash(F.col("text")).alias("key_hash"))
    return dedup.keep_first(hashed, ["key_hash"], ["doc_id"]).select("doc_id", "kept", "key_hash")


@query(f"SELECT arg_min(md5(text), doc_id) AS first_text, count(*) AS n FROM documents WHERE {_KEY} <> '' GROUP BY {_KEY} HAVING count(*) > 1")
def duplicate_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return dedup.duplicate_map(d, T.normalize_key(F.col("text")), F.md5("text"), F.col("doc_id")).select(F.col("display").alias("first_text"), "n")


@query(f"SELECT coalesce(sum(n - 1), 0)::BIGINT AS excess FROM (SELECT count(*) AS n FROM documents GROUP BY {_KEY})")
def duplicate_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _docs(spark, sf_dir).groupBy(T.output_hash(F.col("text"))).agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excess"))


def _worded(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.transform(T.words(F.coalesce("text", F.lit(""))), lambda w: F.xxhash64(w))
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("")).alias("within"), words.alias("grams"))


def _near_groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """id, node of every document, and g, h, jaccard of similar nodes: documents of one language with equal 5-grams are one."""
    return dedup.gram_groups(_worded(spark, sf_dir), F.lit(True), 0.82, 5)


_GRAM_SETS = f"""
g AS (SELECT doc_id, coalesce(lang, '') AS lang, list_distinct({_grams_sql(5)}) AS g FROM (SELECT doc_id, lang, {_WORDS.replace('text', "coalesce(text, '')")} AS w FROM documents)),
m AS (SELECT doc_id, lang, g, CASE WHEN len(g) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY lang, list_sort(g)) END AS first FROM g),
e AS (SELECT doc_id, lang, len(g) AS n, unnest(g) AS gram FROM m WHERE doc_id = first)
"""


@query(f"""WITH {_GRAM_SETS}, every AS (SELECT doc_id, lang, len(g) AS n, unnest(g) AS gram FROM g)
SELECT a.doc_id AS a, b.doc_id AS b, round(count(*) / (any_value(a.n) + any_value(b.n) - count(*)), 6) AS jaccard
FROM every a JOIN every b ON a.gram = b.gram AND a.lang = b.lang AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.82""")
def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of documents of one language whose sets of word 5-grams have Jaccard similarity 0.82 or more, copies among them."""
    ids, near = _near_groups(spark, sf_dir)
    return dedup.member_pairs(ids, near).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query(f"WITH {_GRAM_SETS} SELECT doc_id, first AS class FROM m")
def near_duplicate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each document: the least id of those of its language with the same word 5-grams; without any, its own."""
    ids = overlap.equal_sets(_worded(spark, sf_dir), 5)
    return ids.select(F.col("id").alias("doc_id"), F.col("node").alias("class"))


@query(f"""
WITH RECURSIVE g AS (SELECT doc_id, lang, list_distinct({_grams_sql(5)}) AS g FROM (SELECT doc_id, lang, {_WORDS} AS w FROM documents) WHERE len(w) >= 5),
e AS (SELECT doc_id, lang, len(g) AS n, unnest(g) AS gram FROM g),
near AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.gram = b.gram AND a.lang = b.lang AND a.doc_id < b.doc_id
  GROUP BY 1, 2 HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.82),
listed AS MATERIALIZED (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, blocked, coalesce(l, []) AS earlier FROM (SELECT doc_id, coalesce(len(regexp_extract_all(text, '{_WORD}')) < 20, false) AS blocked FROM documents)
  LEFT JOIN (SELECT b AS doc_id, list(a) AS l FROM near GROUP BY b) USING (doc_id)),
walk AS (
  SELECT 0::BIGINT AS rn, NULL::BIGINT AS doc_id, []::BIGINT[] AS accepted, NULL::VARCHAR AS state
  UNION ALL
  SELECT rn, doc_id, CASE WHEN state = 'accepted' THEN list_append(accepted, doc_id) ELSE accepted END, state FROM (
    SELECT l.rn, l.doc_id, w.accepted, CASE WHEN list_has_any(l.earlier, w.accepted) THEN 'duplicate' WHEN l.blocked THEN 'blocked' ELSE 'accepted' END AS state FROM walk w JOIN listed l ON l.rn = w.rn + 1))
SELECT doc_id AS id, state FROM walk WHERE rn > 0""")
def greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accept-dependent near-duplicate removal: documents under 20 words are rejected later and block nothing."""
    rows = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.coalesce(T.word_count(F.col("text")) < 20, F.lit(False)).alias("blocked"))
    ids, near = _near_groups(spark, sf_dir)
    return dedup.greedy(rows.join(ids, "id"), [], "node", near.select("g", "h")).select("id", "state")


@query(f"""
SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY o, doc_id) AS r2 FROM (
  SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY o, doc_id) AS r1 FROM (
    SELECT doc_id, source, lang, md5('{SEED}:' || source || ':' || doc_id) AS o FROM documents)) WHERE r1 <= 8) WHERE r2 <= 20""")
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 8 documents of a language and 20 in all of each source, in hash order."""
    d = _docs(spark, sf_dir).select("doc_id", "source", "lang")
    return sampling.capped(d, "source", "lang", 8, 20, SEED, "doc_id")


@query(f"""
SELECT doc_id, lang, CASE WHEN r <= CASE WHEN n <= 1 THEN 0 ELSE least(n - 1, greatest(1, round_even(n * 0.02, 0))) END THEN 'val' ELSE 'train' END AS split
FROM (SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY md5('{SEED}:' || lang || ':' || doc_id), doc_id) AS r FROM documents)""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_split(_docs(spark, sf_dir).select("doc_id", "lang"), "lang", "doc_id", 0.02, SEED)


@query(f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('{SEED}:' || lang || ':' || doc_id), doc_id) AS r FROM documents) WHERE r <= 5")
def audit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_per_group(_docs(spark, sf_dir).select("doc_id", "lang"), "lang", "doc_id", 5, SEED)


@query(f"""
SELECT doc_id, lang, row_number() OVER (ORDER BY i, lang) - 1 AS position, (row_number() OVER (ORDER BY i, lang) - 1) // 100 AS shard
FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('{SEED}:' || lang || ':' || doc_id), doc_id) AS i FROM documents)""")
def interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.interleaved_shards(_docs(spark, sf_dir).select("doc_id", "lang"), "lang", "doc_id", 100, SEED)


@query("""
SELECT d.doc_id, l.doc_id IS NOT NULL AS scored, l.doc_id IS NULL OR (l.toxic = 0 AND (5 * l.quality + 5 * (1 - l.toxic)) / 2 >= 4) AS passed
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def score_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents joined with their scores, and whether these let them pass."""
    five = lambda c: (c * 5).cast("double")
    scores = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.create_map(F.lit("quality"), five(F.col("quality")), F.lit("safety"), five(1 - F.col("toxic"))).alias("scores"))
    joined = _docs(spark, sf_dir).select("doc_id").join(scores, "doc_id", "left")
    return joined.select("doc_id", F.col("scores").isNotNull().alias("scored"), rules.score_pass(F.col("scores")).alias("passed"))


_TASKS = "[" + ", ".join(f"'{t}'" for t in (*K.TASK_TYPES, "other")) + "]"


@query("""
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'missing_fields' WHEN doc_id % 10 = 9 THEN 'invalid_task_type' WHEN lang <> 'en' THEN 'invalid_language'
  WHEN trim(text) = '' THEN 'empty_output' END AS reason FROM documents""")
def row_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw JSON rows made of the documents, by the first structural rule that each breaks."""
    from .sources.jsonl import ROW

    task = F.element_at(F.array(*map(F.lit, (*K.TASK_TYPES, "other"))), (F.col("doc_id") % 10 + 1).cast("int"))
    given = F.when(F.col("doc_id") % 7 != 0, "")
    raw = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), "source", task.alias("task_type"), F.lit(INSTRUCTION).alias("instruction"), given.alias("input"), F.col("text").alias("output"), F.col("lang").alias("language"), F.struct(F.lit(1).alias("v")).alias("metadata")))
    parsed = _docs(spark, sf_dir).select("doc_id", raw.alias("value")).select("doc_id", F.from_json("value", ROW).alias("row"), F.json_object_keys("value").alias("keys"), F.schema_of_variant(F.try_variant_get(F.try_parse_json("value"), "$.metadata", "variant")).startswith("OBJECT").alias("meta"))
    return parsed.select("doc_id", rules.raw_row(F.col("keys"), F.col("row"), F.lit(None).cast("string"), F.coalesce("meta", F.lit(False))).alias("reason"))


@query("""
WITH v AS (SELECT lang, list_sort(list(n_chars)) AS l FROM documents GROUP BY lang)
SELECT lang, len(l) AS n, l[1] AS least, l[len(l)] AS most, round_even(list_avg(l), 3) AS mean, round_even(list_median(l), 3) AS median, l[floor(0.9 * (len(l) - 1))::BIGINT + 1]::DOUBLE AS p90 FROM v""")
def length_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.numbers(_docs(spark, sf_dir), F.col("n_chars"), ["lang"])


@query(f"SELECT opening, count(*) AS n FROM (SELECT doc_id, array_to_string({_WORDS}[1:3], ' ') AS opening, len({_WORDS}) AS k FROM documents) WHERE k >= 1 GROUP BY 1 ORDER BY n DESC, min(doc_id), opening LIMIT 20")
def common_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    openings = _docs(spark, sf_dir).select("doc_id", T.opening(F.col("text"), 3).alias("opening")).where("opening IS NOT NULL")
    return profile.most_common(openings, "opening", "doc_id", 20)


@query(f"SELECT opening, count(*) AS n FROM (SELECT doc_id, array_to_string({_WORDS}[1:4], ' ') AS opening, len({_WORDS}) AS k FROM documents) WHERE k >= 4 GROUP BY 1 ORDER BY n DESC, min(doc_id), opening LIMIT 20")
def common_long_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    openings = _docs(spark, sf_dir).select("doc_id", T.opening(F.col("text"), 4, 4).alias("opening")).where("opening IS NOT NULL")
    return profile.most_common(openings, "opening", "doc_id", 20)


@query("SELECT name, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS name FROM documents) WHERE regexp_full_match(name, '[A-Z][a-z]{2,}') AND name NOT IN (" + ", ".join(f"'{x}'" for x in K.NOT_NAMES) + ") GROUP BY 1 ORDER BY n DESC, min(doc_id), name LIMIT 30")
def common_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _docs(spark, sf_dir).select("doc_id", F.explode(T.names(F.col("text"))).alias("name"))
    return profile.most_common(found, "name", "doc_id", 30)


@query("SELECT 'lang' AS dim, lang AS key, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def grouped_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.grouped_counts(_docs(spark, sf_dir), ["lang", "source"])


@query(f"""
SELECT doc_id, len({_WORDS}) AS n_words, round(len(list_distinct({_WORDS})) / nullif(len({_WORDS}), 0), 6) AS unique_ratio,
  len(regexp_extract_all(text, '\\p{{Nd}}')) AS n_digits, regexp_matches(text, '(?i)https?://|www\\.') AS has_url,
  regexp_matches(text, '[A-Za-z]{{14,}}|(?i)[bcdfghjklmnpqrstvwxyz]{{5,}}') AS weird, sha256({_KEY}) AS key_hash FROM documents""")
def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("text")
    worded = _docs(spark, sf_dir).select("doc_id", "text", T.words(x).alias("w"))
    return worded.select("doc_id", F.size("w").cast("long").alias("n_words"), F.round(T.unique_ratio(F.col("w")), 6).alias("unique_ratio"), T.digits(x).cast("long").alias("n_digits"), T.has_url(x).alias("has_url"), T.weird_nonword(x).alias("weird"), T.output_hash(x).alias("key_hash"))


@query(f"""
WITH p AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, '{K.USER}' || chr(10) || {_STRIP.format('text')} || chr(10) || chr(10) || '{K.ASSISTANT}' || chr(10) || t2 || '{K.END}' AS sample FROM p WHERE role = 'user' AND r2 = 'assistant'""")
def chat_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User and assistant turns that follow each other, as training texts."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("*", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("answer")).where("role = 'user' AND next_role = 'assistant'")
    return pairs.select("conv_id", "turn", F.concat(T.chat_prompt(F.col("text"), F.lit("")), "answer", F.lit(K.END)).alias("sample"))


@query("""
WITH c AS (SELECT doc_id, list_transform(list_filter(string_split(coalesce(text, ''), ''), lambda x: x <> ''), lambda x: ord(x)::BIGINT) AS l FROM documents),
h AS (SELECT doc_id, l[1:len(l) // 2] AS p, l[len(l) // 2 + 1:] AS o FROM c)
SELECT doc_id, array_to_string(list_concat(p, o[1:len(o) - 1]), ',') AS input_ids, array_to_string(list_concat(list_transform(p[2:], lambda x: -100::BIGINT), o), ',') AS labels, len(p) > 0 AND len(o) > 0 AND len(p) + len(o) - 1 <= 8000 AS fits FROM h""")
def masked_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shifted inputs and masked labels of every text, and whether they fit 8000 places; ids are code points, the first half is the prompt.

    A text of one character has no prompt, an empty or null one nothing at all; neither fits.
    """
    codes = F.transform(F.filter(F.split(F.coalesce("text", F.lit("")), ""), lambda c: c != ""), lambda c: F.expr("0").cast("long") + F.ascii(c))
    half = F.floor(F.size("l") / 2).cast("int")
    d = _docs(spark, sf_dir).select("doc_id", codes.alias("l")).select("doc_id", F.slice("l", F.lit(1), half).alias("p"), F.slice("l", half + 1, F.size("l")).alias("o"))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return d.select("doc_id", text(tokens.input_ids(F.col("p"), F.col("o"))).alias("input_ids"), text(tokens.labels(F.col("p"), F.col("o"))).alias("labels"), tokens.fits(F.col("p"), F.col("o"), 8000).alias("fits"))


_SCORED = """
SELECT *, CASE WHEN crit THEN -1 WHEN major THEN 0 WHEN minor THEN 1 ELSE 2 END AS score,
  CASE WHEN crit THEN 'critical' WHEN major THEN 'major' WHEN minor THEN 'minor' ELSE 'ok' END AS severity
FROM (SELECT *, list_contains(flags, 'critical_safety_fail') AS crit, list_has_any(flags, ['reasoning_fail', 'list_fail', 'loop_repetition', 'simple_qa_fail', 'identity_fail', 'story_drift_non_story']) AS major,
  list_has_any(flags, ['too_long_non_story', 'as_ai_phrase']) AS minor FROM (
  SELECT doc_id AS id, source || '_' || doc_id % 3 AS candidate, [{categories}][((doc_id // 3) % 6 + 1)::INT] AS category, list_filter([
    CASE WHEN n_chars > 2000 THEN 'too_long_non_story' END, CASE WHEN n_chars < 40 THEN 'incomplete_answer' END,
    CASE WHEN doc_id % 3 = 2 AND contains(text, 'AKIA') THEN 'critical_safety_fail' END, CASE WHEN doc_id % 3 = 2 AND n_chars % 11 = 0 THEN 'reasoning_fail' END,
    CASE WHEN doc_id % 3 = 2 AND n_chars % 13 = 0 THEN 'simple_qa_fail' END, CASE WHEN doc_id % 3 > 0 AND n_chars % 2 = 0 AND (doc_id // 3) % 6 = 2 THEN 'list_fail' END,
    CASE WHEN doc_id % 3 > 0 AND n_chars % 3 = 0 AND (doc_id // 3) % 6 = 0 THEN 'identity_fail' END, CASE WHEN doc_id % 3 = 2 AND n_chars % 7 = 0 THEN 'story_drift_non_story' END,
    CASE WHEN doc_id % 3 = 2 AND n_chars % 19 = 0 THEN 'loop_repetition' END], lambda x: x IS NOT NULL) AS flags FROM documents)) s
""".format(categories=", ".join(f"'{c}'" for c in K.NON_STORY_CATEGORIES))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows made of the documents: each source gives a good, a middling and a bad candidate; flags follow from lengths and marks."""
    size, kind, at = F.col("n_chars"), F.col("doc_id") % 3, F.floor(F.col("doc_id") / 3) % 6
    bad, weak = kind == 2, kind > 0
    marks = [(size > 2000, "too_long_non_story"), (size < 40, "incomplete_answer"), (bad & F.contains("text", F.lit("AKIA")), "critical_safety_fail")]
    marks += [(bad & (size % 11 == 0), "reasoning_fail"), (bad & (size % 13 == 0), "simple_qa_fail"), (weak & (size % 2 == 0) & (at == 2), "list_fail")]
    marks += [(weak & (size % 3 == 0) & (at == 0), "identity_fail"), (bad & (size % 7 == 0), "story_drift_non_story"), (bad & (size % 19 == 0), "loop_repetition")]
    flags = F.filter(F.array(*[F.when(held, flag) for held, flag in marks]), lambda x: x.isNotNull())
    category = F.element_at(F.array(*map(F.lit, K.NON_STORY_CATEGORIES)), (at + 1).cast("int"))
    rows = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.concat_ws("_", "source", kind.cast("string")).alias("candidate"), category.alias("category"), flags.alias("flags"))
    rows = rows.withColumn("severity", evaluation.severity(F.col("flags"), F.array_contains("flags", "critical_safety_fail")))
    return rows.withColumn("score", evaluation.score(F.col("severity")))


def _rate_sql(condition: str, of: str) -> str:
    return f"coalesce(count_if({condition} AND {of}) / nullif(count_if({of}), 0), 0)"


_DECISION = f"""
SELECT candidate, total, total_score, average_score, critical_safety, qa, reasoning, identity, lists, drift, loops,
  CASE WHEN critical_safety = 0 AND r1 = 0 AND r2 <= 0.15 AND r3 <= 0.25 AND r4 <= 0.15 AND r5 <= 0.25 AND drift <= 0.1 * total AND loops <= 0.1 * total THEN 'PASS_DEMO'
    WHEN critical_safety > 0 OR qa >= 2 OR reasoning >= 2 OR drift >= greatest(2, total // 5) OR loops >= greatest(2, total // 5) THEN 'NO_GO'
    ELSE 'NEEDS_TARGETED_CORRECTION' END AS decision
FROM (SELECT candidate, count(*) AS total, sum(score)::BIGINT AS total_score, avg(score) AS average_score, count_if(crit) AS critical_safety,
  count_if(list_contains(flags, 'simple_qa_fail')) AS qa, count_if(list_contains(flags, 'reasoning_fail')) AS reasoning, count_if(list_contains(flags, 'identity_fail')) AS identity,
  count_if(list_contains(flags, 'list_fail')) AS lists, count_if(list_contains(flags, 'story_drift_non_story')) AS drift, count_if(list_contains(flags, 'loop_repetition')) AS loops,
  {_rate_sql("score <= 0", "category = 'safety_kindness'")} AS r1, {_rate_sql("score <= 0", "category = 'simple_qa'")} AS r2,
  {_rate_sql("score <= 0", "category = 'simple_reasoning'")} AS r3, {_rate_sql("score <= 0", "category = 'simple_list'")} AS r4, {_rate_sql("list_contains(flags, 'identity_fail')", "category = 'identity_chat'")} AS r5
  FROM ({_SCORED}) GROUP BY candidate)
"""


@query(f"SELECT candidate, total, total_score, round(average_score, 6) AS average_score, critical_safety, qa, reasoning, identity, lists, drift, loops, decision FROM ({_DECISION})")
def eval_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and decision of each candidate."""
    found = evaluation.decision(_scored(spark, sf_dir), ["candidate"])
    return found.select("candidate", "total", "total_score", F.round("average_score", 6).alias("average_score"), "critical_safety", "qa", "reasoning", "identity", "lists", "drift", "loops", "decision")


@query(f"""
SELECT candidate, decision, row_number() OVER (ORDER BY list_position(['NO_GO', 'NEEDS_TARGETED_CORRECTION', 'PASS_DEMO'], decision) DESC, critical_safety, total_score DESC, average_score DESC, candidate) AS rank,
  critical_safety = 0 AND decision <> 'NO_GO' AS trainable FROM ({_DECISION})""")
def rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = evaluation.rank_candidates(evaluation.decision(_scored(spark, sf_dir), ["candidate"]), "candidate")
    return ranked.select("candidate", "decision", F.col("rank").cast("long").alias("rank"), "trainable")


@query(f"SELECT category, count(*) AS n, round(avg(score), 6) AS average_score, round(count_if(score <= 0) / count(*), 6) AS fail_rate, count_if(severity = 'critical') AS critical, count_if(severity = 'major') AS major FROM ({_SCORED}) GROUP BY 1")
def eval_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.category_summary(_scored(spark, sf_dir), [])
    return found.select("category", "n", F.round("average_score", 6).alias("average_score"), F.round("fail_rate", 6).alias("fail_rate"), "critical", "major")


@query(f"SELECT candidate, flag, count(*) AS n FROM (SELECT candidate, unnest(flags) AS flag FROM ({_SCORED})) GROUP BY 1, 2")
def eval_flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.flag_counts(_scored(spark, sf_dir), ["candidate"])


@query(f"SELECT id, severity, score::INT AS score FROM ({_SCORED}) WHERE score <= 0")
def eval_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.errors(_scored(spark, sf_dir)).select("id", "severity", "score")


_NEEDS = " UNION ALL ".join(f"SELECT '{b}' AS bucket, id FROM s WHERE list_has_any(flags, [{', '.join(repr(f) for f in fs)}])" for b, fs in K.HARD_NEGATIVES.items())


@query(f"WITH s AS ({_SCORED}), c AS ({_NEEDS}) SELECT bucket, count(*) AS n, array_to_string(list_sort(list(id))[1:6], ',') AS ids FROM c GROUP BY 1")
def eval_data_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows call for each kind of hard negatives, and the first six of them."""
    found = evaluation.data_needs(_scored(spark, sf_dir), "id")
    return found.select("bucket", "n", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
