"""Append logs: records added as JSON lines, and a summary that a stream keeps up to date over restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import audit

RECORD = "step bigint, train_loss double, val_loss double, note string"
TAIL = 5


def append(records: DataFrame, path: str) -> None:
    """Add records to a log: new files beside those that are there, nulls kept."""
    records.write.mode("append").option("ignoreNullFields", "false").json(path)


def read(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    return spark.read.schema(schema).json(path)


def summary(log: DataFrame, tail: int = TAIL) -> DataFrame:
    """final_train_loss (of the last step), best_val_loss, records (the last, whole) of a log."""
    return audit.log_summary(log, "step", "train_loss", "val_loss", tail).select("final_train_loss", "best_val_loss", "records")


def _state(rows: DataFrame, tail: int) -> DataFrame:
    """One row that says as much of ``rows`` as a later summary needs."""
    last = F.slice(F.sort_array(F.collect_list(F.struct("step", "train_loss", "val_loss", "note")), asc=False), 1, tail)
    recent = rows.orderBy(F.desc("step")).limit(tail).agg(last.alias("records"))
    return rows.agg(F.min("val_loss").alias("best_val_loss")).crossJoin(F.broadcast(recent))


def follow(spark: SparkSession, path: str, state: str, checkpoint: str, schema: str = RECORD, tail: int = TAIL) -> StreamingQuery:
    """Take what has been added to the log since the last time into the summary below ``state``, and end.

    Each batch is reduced to one row and merged with the state before it, as the state of its own number; a batch that
    is run again after a failure starts from the same state and writes the same row, and the stream's checkpoint tells
    which files have been taken.
    """

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        new = _state(batch, tail)
        if number:
            old = session.read.parquet(f"{state}/batch={number - 1}")
            both = old.select("best_val_loss", "records").unionByName(new)
            rows = both.select(F.explode("records").alias("r")).select("r.*").distinct()
            new = rows.orderBy(F.desc("step")).limit(tail).agg(F.sort_array(F.collect_list(F.struct("step", "train_loss", "val_loss", "note")), asc=False).alias("records")).crossJoin(both.agg(F.min("best_val_loss").alias("best_val_loss")))
        new.select("best_val_loss", "records").write.mode("overwrite").parquet(f"{state}/batch={number}")

    rows = spark.readStream.schema(schema).json(path)
    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def followed(spark: SparkSession, state: str) -> DataFrame:
    """The summary that ``follow`` has kept: that of the last batch."""
    every = spark.read.parquet(state)
    last = every.agg(F.max("batch").alias("batch"))
    one = every.join(F.broadcast(last), "batch")
    return one.select(F.get("records", F.lit(0))["train_loss"].alias("final_train_loss"), "best_val_loss", F.reverse("records").alias("records"))
