"""The corpus pipeline: toxicity, near duplicates, repeated passages, secrets, packing, each on what the last one kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and
reads it again as the next stage's ``docs``.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuskiln.llm.common import materialize
from corpuskiln.llm.neardup import drop_near_duplicates
from corpuskiln.llm.packing import pack_documents
from corpuskiln.llm.secrets import redact
from corpuskiln.llm.substring import remove_repeats
from corpuskiln.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go; see ``llm.toxicity``.

    Null, empty and wordless texts are not toxic and stay, as do rows with null ids, which never train; very long texts are
    scored whole; equal texts share their fate, repeated rows too; without labels of both kinds all stay; an empty table
    stays empty; other columns, whatever their names, come back as they were.
    """
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of least id stays; see ``llm.neardup``.

    Null and blank texts are each a class of their own and stay; very long texts are compared whole; of repeated rows
    one stays, of equal ids (ties) that of the least text hash; rows with null ids stay only where no member of their class has an id;
    an empty table stays empty; other columns, whatever their names, come back as they were.
    """
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that occur elsewhere too go; see ``llm.substring``.

    Documents stay, those without words left as empty texts; null texts stay null, and texts shorter than a window lose
    nothing; very long texts are searched whole; of repeated rows and equal passages (ties) every copy loses its words;
    an empty table stays empty; n_chars follows the text; other columns, whatever their names, come back as they were.
    """
    return remove_repeats(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by marks; see ``llm.secrets``.

    Documents stay, null and empty texts as they are; very long texts are scanned whole; spans that start together (ties)
    go in the order of kinds; repeated rows repeat; an empty table stays empty; n_chars follows the text; other columns,
    whatever their names, come back as they were.
    """
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept texts as token sequences, a row for each piece; see ``llm.packing``.

    A null or empty text is the end mark alone; very long texts become as many pieces as it takes; repeated rows and
    ties are packed each on its own; an empty table gives no rows; other columns, whatever their names, are ignored.
    """
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: A trained machine, banding and a tokenizer can't be said in SQL; tests/llm/test_pipeline.py goes through the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
