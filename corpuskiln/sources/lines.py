"""Lines of text files with their places, read in splits: no file needs to lie in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINES = "file string, path string, block bigint, line bigint, ordinal bigint, value string"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything matches ``path`` (a file, a folder or a pattern) in its file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def read_lines(spark: SparkSession, path: str | list[str], missing_ok: bool = False, limit: int | None = None) -> DataFrame:
    """file, path, block, line, ordinal, value of every line of one or more files.

    ``block`` is the byte where a line's split begins, ``line`` its number in the file (from 1), ``ordinal`` its number
    over all files, which follow each other by path.  Lines end at a line feed, a carriage return or both; a byte-order
    mark at a file's start goes.  ``limit`` keeps the first lines of all files together.  With ``missing_ok`` a path that
    nothing matches gives no lines.

    Spark reads a file's splits in any order and place.  Within a split its row numbers go up by one, so a first pass
    counts each split's lines and takes its least row number; sums of the counts tell how many lines come before a
    split, and a second pass gives each line its number by subtraction.  Lines aren't shuffled for it: what meets them is
    a row for each split.
    """
    paths = [path] if isinstance(path, str) else path
    if missing_ok:
        paths = [p for p in paths if exists(spark, p)]
        if not paths:
            return spark.createDataFrame([], LINES)
    meta = F.col("_metadata")
    rows = spark.read.text(paths).select(meta["file_path"].alias("path"), meta["file_name"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("row"), "value")
    counted = rows.groupBy("path", "block").agg(F.min("row").alias("least"), F.count("*").alias("n"))
    sums = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = counted.groupBy("path").agg(F.sum("n").alias("n")).select("path", sums(Window.orderBy("path")).alias("earlier"))  # a row for each file
    splits = counted.select("path", "block", "least", sums(Window.partitionBy("path").orderBy("block")).alias("before")).join(files, "path")
    placed = rows.join(splits, ["path", "block"]).withColumn("line", F.col("row") - F.col("least") + F.col("before") + 1)
    value = F.when(F.col("line") == 1, F.regexp_replace("value", "^\\x{FEFF}", "")).otherwise(F.col("value"))
    out = placed.select("file", "path", "block", "line", (F.col("earlier") + F.col("line")).alias("ordinal"), value.alias("value"))
    return out if limit is None else out.where(F.col("ordinal") <= limit)
