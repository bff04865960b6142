"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_STORED: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, from ``spark.checkpoint.dir``; only a local master may do without, and gets a folder of its own."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corpuskiln-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files of plans that nothing refers to any more, before the next large step.

    Twice, with a pause: the listeners of the last query hold its plan until they have been told of its end.
    """
    for _ in range(2):
        time.sleep(0.5)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a compressed Parquet table in the shared folder, which cuts its lineage; removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    if not _STORED:
        atexit.register(_clean)
    _STORED.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _clean() -> None:
    for spark, path in _STORED:
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session has ended; the cluster's own cleaning is left to do it
            return
