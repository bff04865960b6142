"""Queries over token streams: documents as line streams, cut into segments, encoded, and laid out in blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import diagnose, stream, tokenset

BLOCK, FRACTION, VOCAB = 256, 0.1, 8191
_B = stream.BLANK
#: Documents of a block of their source's line stream.
BLOCK_DOCS = 500
_SEGMENTS = rf"""
WITH lines AS (
  SELECT file, doc_id, generate_subscripts(l, 1) AS line, unnest(l) AS value FROM (
    SELECT coalesce(source, '') AS file, doc_id, list_concat(string_split_regex(coalesce(text, ''), '\r\n|[\r\n]'), CASE doc_id % 3 WHEN 0 THEN [' '] WHEN 1 THEN ['{stream.MARK}'] ELSE [] END) AS l FROM documents)),
flags AS (SELECT *, regexp_replace(value, '[{_B}]+', '', 'g') = '' AS blank, contains(value, '{stream.MARK}') AS marked FROM lines),
numbered AS (SELECT *, coalesce(sum(CASE WHEN blank OR marked THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY doc_id, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS segment FROM flags),
whole AS (SELECT file, segment, regexp_replace(string_agg(value, chr(10) ORDER BY doc_id, line), '^[{_B}]+|[{_B}]+$', '', 'g') AS t FROM numbered WHERE NOT blank GROUP BY file, segment),
every AS (SELECT f.file, coalesce(segment, 0) AS segment, coalesce(t, '') AS t FROM (SELECT DISTINCT file FROM lines) f LEFT JOIN whole USING (file)),
segments AS (SELECT file, segment,
  CASE WHEN contains(t, '{stream.MARK}') THEN t WHEN t = '' THEN '{stream.MARK}' ELSE t || chr(10) || '{stream.MARK}' END || chr(10) AS text FROM every)
"""
_IDS = rf"""{_SEGMENTS},
words AS (SELECT file, segment, generate_subscripts(w, 1) AS i, unnest(w) AS w FROM (SELECT file, segment, regexp_extract_all(text, '[^ \t\r\n\x0B\f]+') AS w FROM segments)),
stream AS (
  SELECT row_number() OVER (ORDER BY file, segment, i) - 1 AS place, CASE WHEN w = '{stream.MARK}' THEN 0 ELSE ('0x' || substr(md5(w), 1, 4))::INTEGER % {VOCAB - 1} + 1 END AS id FROM words),
total AS (SELECT count(*) AS n FROM stream),
sizes AS (SELECT n, n - greatest({BLOCK} + 2, floor(n * {FRACTION})::BIGINT) AS train FROM total),
sides AS (SELECT CASE WHEN place < train THEN 'train' ELSE 'val' END AS split, CASE WHEN place < train THEN place ELSE place - train END AS place, CASE WHEN place < train THEN train ELSE n - train END AS size, id FROM stream, sizes)
"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's documents as one file of stories: a third end with a blank line, a third with the mark, a third run on."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.coalesce("source", F.lit("")).alias("file"), "doc_id", "text")
    after = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(" "))).when(F.col("doc_id") % 3 == 1, F.array(F.lit(stream.MARK))).otherwise(F.array().cast("array<string>"))
    lines = docs.select("file", "doc_id", F.posexplode(F.concat(F.split(F.coalesce("text", F.lit("")), "\r\n|[\r\n]"), after)).alias("at", "value"))
    placed = lines.select("file", F.floor(F.col("doc_id") / BLOCK_DOCS).alias("block"), F.struct("doc_id", "at").alias("line"), "value")
    return stream.segments(placed, block="block")


@query(rf"{_SEGMENTS} SELECT file AS source, segment, md5(text) AS digest, octet_length(encode(text))::BIGINT AS n_bytes FROM segments")
def story_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of each source's stories, between blank lines and end marks, wherever documents begin."""
    return _segments(spark, sf_dir).select(F.col("file").alias("source"), "segment", F.md5("text").alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"))


def _token_set(spark: SparkSession, sf_dir: str) -> tokenset.TokenSet:
    encoded = tokenset.word_ids(_segments(spark, sf_dir), {"ids": "text"}, VOCAB)
    return tokenset.prepare(encoded, ["file", "segment"], BLOCK, FRACTION, VOCAB)


@query(rf"""{_IDS},
xs AS (SELECT split, place // {BLOCK} AS block, string_agg(id, ',' ORDER BY place) AS x FROM sides WHERE place // {BLOCK} < (size - 1) // {BLOCK} GROUP BY ALL),
ys AS (SELECT split, (place - 1) // {BLOCK} AS block, string_agg(id, ',' ORDER BY place) AS y FROM sides WHERE place > 0 AND (place - 1) // {BLOCK} < (size - 1) // {BLOCK} GROUP BY ALL)
SELECT split, block, x, y FROM xs JOIN ys USING (split, block)""")
def token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' segments as one token stream, its last tenth for validation, in windows x and y of 256 ids."""
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return _token_set(spark, sf_dir).blocks().select("split", "block", text("x"), text("y"))


@query(rf"{_IDS} SELECT split, any_value(size)::BIGINT AS tokens, count(DISTINCT id) AS kinds, sum(id)::BIGINT AS checksum, sum(CASE WHEN id = 0 THEN 1 ELSE 0 END)::BIGINT AS marks, 1 AS repeat_factor FROM sides GROUP BY split")
def token_set_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, different ids, sum and end marks of both splits of the token set."""
    found = _token_set(spark, sf_dir)
    counts = F.when(F.col("split") == "train", F.lit(found.metadata["train_token_count"])).otherwise(F.lit(found.metadata["val_token_count"])).cast("long")
    ids = found.pieces.select("split", F.explode("ids").alias("id"))
    summed = ids.groupBy("split").agg(F.countDistinct("id").alias("kinds"), F.sum(F.col("id").cast("long")).alias("checksum"), F.count_if(F.col("id") == 0).alias("marks"))
    return summed.select("split", counts.alias("tokens"), "kinds", "checksum", "marks", F.lit(found.metadata["train_repeat_factor"]).alias("repeat_factor"))


#: Inputs that a training row may have, and the prompt's words: the first line of a document.
MOST = 2000
_ROWS = rf"""
WITH parts AS (SELECT doc_id, lang, split_part(regexp_replace(coalesce(text, ''), '\r\n|[\r\n]', chr(1)), chr(1), 1) AS q, coalesce(text, '') AS t FROM documents),
ids AS (SELECT doc_id, lang, list_transform(regexp_extract_all(q, '[^ \t\r\n\x0B\f]+'), lambda w: ('0x' || substr(md5(w), 1, 4))::INTEGER % {VOCAB - 1} + 1) AS p,
  list_transform(regexp_extract_all(substr(t, length(q) + 1), '[^ \t\r\n\x0B\f]+'), lambda w: ('0x' || substr(md5(w), 1, 4))::INTEGER % {VOCAB - 1} + 1) || CASE WHEN doc_id % 7 = 0 THEN [] ELSE [0] END AS o FROM parts),
judged AS (SELECT *, CASE WHEN len(p) = 0 THEN 'empty_prompt' WHEN len(o) = 0 THEN 'empty_output' WHEN len(p) + len(o) - 1 > {MOST} THEN 'too_long' END AS problem FROM ids)
"""


def _training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as training rows: the first line asks, the rest answers; every seventh lacks its end mark."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("t"))
    cut = docs.select("doc_id", "lang", "t", F.regexp_extract("t", r"^[^\r\n]*", 0).alias("q"))
    end = F.when(F.col("doc_id") % 7 == 0, "").otherwise("\n" + stream.MARK)
    texts = cut.select("doc_id", "lang", "q", F.concat(F.expr("substring(t, length(q) + 1)"), end).alias("rest"))
    return diagnose.features(tokenset.word_ids(texts, {"prompt": "q", "output": "rest"}, VOCAB), MOST)


@query(f"""{_ROWS}, f AS (SELECT *, len(p) + len(o) - 1 AS tokens, len(o) AS supervised FROM judged)
SELECT lang, count_if(problem IS NULL) AS examples, count_if(problem IS NOT NULL) AS problems, count_if(problem IS NULL AND supervised = 0) AS zero_supervised, count_if(problem IS NULL AND o[1] = 0) AS first_is_end,
  count_if(problem IS NULL AND len(list_filter(o, lambda x: x <> 0)) = 0) AS only_end, round(sum(len(list_filter(o, lambda x: x = 0))) FILTER (problem IS NULL) / sum(supervised) FILTER (problem IS NULL), 6) AS end_label_ratio,
  {", ".join(f"min({c}) FILTER (problem IS NULL)::INTEGER AS {c}_least, max({c}) FILTER (problem IS NULL)::INTEGER AS {c}_most, round_even(avg({c}) FILTER (problem IS NULL), 3) AS {c}_mean, round_even(median({c}) FILTER (problem IS NULL), 3) AS {c}_median" for c in ("tokens", "supervised"))} FROM f GROUP BY lang""")
def row_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths, supervised labels and end marks of the training rows of each language."""
    return diagnose.diagnosis(_training_rows(spark, sf_dir), "lang", 0)


@query(f"""{_ROWS}, c AS (SELECT lang, o[1] AS token, count(*) AS n, min(doc_id) AS first FROM judged WHERE problem IS NULL GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY n DESC, first, token)::INTEGER AS place, token, n FROM c QUALIFY place <= 20""")
def first_supervised_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty most frequent first supervised tokens of each language."""
    return diagnose.first_supervised(_training_rows(spark, sf_dir), "lang", "doc_id")
