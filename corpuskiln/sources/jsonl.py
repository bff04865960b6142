"""JSONL, text and score sources and sinks.  Lines keep their place: (file, line) is the order that operators rely on."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lines

ROW = "id string, source string, task_type string, instruction string, input string, output string, language string"


def read_lines(spark: SparkSession, path: str, missing_ok: bool = False) -> DataFrame:
    """file, line (from 1), value of every line of one or more files, read in splits; with ``missing_ok`` no file is no lines."""
    return lines.read_lines(spark, path, missing_ok).select("file", "line", "value")


def parse_objects(rows: DataFrame, schema: str = ROW) -> DataFrame:
    """file, line, value, row (typed), keys, error: null, ``invalid_json`` or ``not_object``; blank lines go."""
    kept = rows.where(F.trim("value") != "")
    variant = F.try_parse_json("value")
    kind = F.schema_of_variant(variant)
    error = F.when(variant.isNull(), "invalid_json").when(~kind.startswith("OBJECT"), "not_object")
    return kept.select("*", F.from_json("value", schema).alias("row"), F.json_object_keys("value").alias("keys"), error.alias("error"))


def read_rows(spark: SparkSession, path: str, schema: str = ROW) -> DataFrame:
    """Typed rows, strict: any broken line is an error; the order columns come along."""
    parsed = parse_objects(read_lines(spark, path), schema)
    broken = F.raise_error(F.concat_ws(":", "file", F.col("line").cast("string"), "error"))
    checked = parsed.withColumn("line", F.when(F.col("error").isNull(), F.col("line")).otherwise(broken.cast("long")))
    return checked.select("file", "line", "row.*")


def write_rows(df: DataFrame, path: str) -> None:
    """JSONL with keys in alphabetical order, null fields written as null; rows are in the order of ``df``."""
    df.select(*sorted(df.columns)).write.option("ignoreNullFields", "false").json(path)


def write_manifest(values: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(values, f, indent=2, sort_keys=True, ensure_ascii=False)


def stories(spark: SparkSession, path: str, mark: str = "<|endoftext|>") -> DataFrame:
    """file, story_index, story: split at the mark where a file has one, else at blank lines."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    cut = F.when(F.contains("value", F.lit(mark)), F.split("value", re.escape(mark))).otherwise(F.split("value", r"\n\s*\n"))
    kept = F.filter(F.transform(cut, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    return whole.select("file", F.posexplode(kept).alias("story_index", "story"))


def latest_scores(scores: DataFrame, order: Column) -> DataFrame:
    """One score row for each example_id: the last."""
    return scores.groupBy("example_id").agg(F.max_by("scores", order).alias("scores"))


@dataclass(frozen=True)
class SourceSpec:
    """``name=path[:cap=N][:task=TYPE=N]...``"""

    name: str
    path: str
    cap: int | None = None
    task_caps: dict[str, int] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> SourceSpec:
        name, found, rest = text.partition("=")
        if not found or not name or not rest:
            raise ValueError(f"not a source: {text!r}")
        option = re.compile(r":(cap=\d+|task=[^:=]+=\d+)")
        cap, tasks = None, {}
        for part in option.findall(rest):
            kind, _, value = part.partition("=")
            if kind == "cap":
                cap = int(value)
            else:
                task, _, n = value.rpartition("=")
                tasks[task] = int(n)
        return cls(name, option.sub("", rest), cap, tasks)
