"""Rows as one stream: running sums over any number of tasks, and the segments of line streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ..functions import text as T
from ..session import stored

MARK = "<|endoftext|>"
#: What Python's ``strip`` and line tests take for white space, inside brackets of a regular expression.
BLANK = r"\s\x0B\x1C-\x1F\x{85}\p{Z}"
#: The same characters one by one.
BLANKS = T.WHITE + "\x1c\x1d\x1e\x1f"


def running_sum(rows: DataFrame, order: list[str], value: str, into: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows before each, in the order of ``order`` (unique; nulls first).

    Rows are sorted into ranges, each is summed within its task, and the ranges' sums are added up: a row for each range.
    What is written in between makes both passes see the same ranges.
    """
    ranged = rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    placed = ranged.withColumn("_range", F.spark_partition_id()).withColumn("_value", F.coalesce(F.col(value).cast("long"), F.lit(0)))
    schema = StructType(list(placed.schema.fields)).add("_local", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            own = batch.column("_value").to_numpy()
            before = total + np.cumsum(own) - own
            total += int(own.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before)], [*batch.schema.names, "_local"])

    summed = stored(placed.mapInArrow(run, schema))
    sizes = summed.groupBy("_range").agg(F.sum("_value").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = summed.join(sizes.select("_range", before.alias("_before")), "_range")
    return joined.withColumn(into, F.col("_before") + F.col("_local")).drop("_range", "_value", "_local", "_before", "_n")


def stripped(text: Column) -> Column:
    """Without ``BLANK`` at both ends; what is between isn't searched."""
    return F.trim(text, F.lit(BLANKS))


def segments(lines: DataFrame, file: str = "file", line: str = "line", value: str = "value", block: str | None = None, mark: str = MARK) -> DataFrame:
    """file, segment, text of a line stream (file, line, value), in the order of lines.

    A segment ends at a blank line or after a line with the mark; its text is stripped, ends with the mark, which is
    added where it lacks, and a line feed.  A file whose lines are all blank has one segment, the mark alone.  ``segment`` is
    the number of ends before it, so it rises within a file, with gaps where ends follow each other.  It is a sum that
    goes on from ``block`` to block of a file (parts of it that hold successive lines, such as a reader's splits;
    without one, a file is one part): blocks are summed apart, their sums added up, a row for each block, and what a
    segment has of each block is put together there and then once more across blocks.
    """
    blank = ~F.coalesce(value, F.lit("")).rlike(f"[^{BLANK}]")
    kept = lines.select(F.col(file).alias("file"), (F.col(block) if block else F.lit(0)).alias("block"), F.col(line).alias("line"), F.when(~blank, F.col(value)).alias("value"))
    ends = (F.col("value").isNull() | F.contains("value", F.lit(mark))).cast("long")
    within = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    parts = kept.withColumn("end", ends).withColumn("local", F.coalesce(F.sum("end").over(within), F.lit(0)))
    parts = parts.groupBy("file", "block", "local").agg(F.sum("end").alias("ends"), F.expr("array_join(transform(array_sort(collect_list(CASE WHEN value IS NOT NULL THEN struct(line, value) END)), x -> x.value), '\n')").alias("text"), F.count("value").alias("n"))
    # stored, as blocks' sums and texts are read apart
    parts = stored(parts)
    sizes = parts.groupBy("file", "block").agg(F.sum("ends").alias("ends"))
    before = F.coalesce(F.sum("ends").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = parts.drop("ends").join(sizes.select("file", "block", before.alias("before")), ["file", "block"])
    whole = joined.where("n > 0").groupBy("file", (F.col("before") + F.col("local")).alias("segment")).agg(F.expr("array_join(transform(array_sort(collect_list(struct(block, text))), x -> x.text), '\n')").alias("text"))
    # files of blank lines alone come apart: a join by file would leave each file's segments to one task
    bare = parts.groupBy("file").agg(F.sum("n").alias("n")).where("n = 0").select("file", F.lit(0).cast("long").alias("segment"), F.lit("").alias("text"))
    found = whole.unionByName(bare).withColumn("text", stripped(F.coalesce("text", F.lit(""))))
    marked = F.when(F.contains("text", F.lit(mark)), F.col("text")).when(F.col("text") == "", F.lit(mark)).otherwise(F.concat("text", F.lit("\n" + mark)))
    return found.select("file", "segment", F.concat(marked, F.lit("\n")).alias("text"))
