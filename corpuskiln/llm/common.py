"""Helpers shared by the operators: the shared folder, materialised tables, rows set aside, batch iteration."""

from __future__ import annotations

import atexit
import gc
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import shared_dir

_TABLES: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _TABLES:
        atexit.register(_clean)
    _TABLES.append((spark, path))
    return path


def materialize(df: DataFrame, name: str, large: bool = False) -> DataFrame:
    """Cut the lineage of ``df`` by a Parquet table in the shared folder, which outlives lost executors.

    Before a ``large`` step shuffle files that nothing needs any more are released.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if large:
        release(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files of plans that nothing refers to any more, before the next large step.

    Twice, with a pause: the listeners of the last query hold its plan until they have been told of its end.
    """
    for _ in range(2):
        time.sleep(0.5)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    for spark, path in _TABLES:
        try:
            remove_path(spark, path)
        except Exception:  # noqa: BLE001  the session has ended; the cluster's own cleaning is left to do it
            return


def quoted(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_text(name: str = "text") -> Column:
    """The text with null as the empty string."""
    return F.coalesce(quoted(name).cast("string"), F.lit(""))


@dataclass(frozen=True)
class SetAside:
    """Rows as two columns, ``row`` (a struct of all other columns by number) and ``text``.

    The operators' own columns stand beside these two, so a column of the caller can't clash with them, and texts are
    held once.  ``back`` gives the caller's columns again, under their names and in their order.
    """

    rows: DataFrame
    names: tuple[str, ...]
    types: StructType
    text_col: str = "text"

    @classmethod
    def of(cls, docs: DataFrame, text_col: str = "text") -> SetAside:
        others = [quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col]
        kept = F.struct(*others) if others else F.struct(F.lit(0).alias("none"))
        return cls(docs.select(kept.alias("row"), quoted(text_col).cast("string").alias("text")), tuple(docs.columns), docs.schema, text_col)

    def column(self, name: str) -> Column:
        """A column of the caller's, in a frame that has ``row`` and ``text``."""
        return F.col("text") if name == self.text_col else F.col(f"row.c{self.names.index(name)}")

    def back(self, df: DataFrame, text_changed: bool = False) -> DataFrame:
        """The caller's columns; if texts changed, n_chars, where present, follows."""
        out = []
        for field in self.types:
            value = self.column(field.name)
            if text_changed and field.name == "n_chars":
                value = F.coalesce(F.length("text").cast(field.dataType), value)
            out.append(value.alias(field.name))
        return df.select(*out)


Batches = Iterator[pa.RecordBatch]

#: What a worker process holds between tasks: each gives it up when called.  Work of another kind calls them all first.
HELD: dict[str, Callable[[], None]] = {}


def sliced(batches: Batches, column: str = "text", size: int = 4_000_000) -> Batches:
    """Re-cut batches so that each holds about ``size`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype("i8"))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(ends.searchsorted(base + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as the empty string."""
    return [t or "" for t in batch.column(column).to_pylist()]


def derived(batch: pa.RecordBatch, kept: list[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The kept columns as they came, so that no value passes through Python, and the new ones."""
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *new.values()], [*kept, *new])


def give_up_all_but(kept: str | None) -> None:
    """A function of the module, so that it runs on the worker's own ``HELD`` and not on a copy sent along."""
    for name, give_up in HELD.items():
        if name != kept:
            give_up()


def map_texts(df: DataFrame, kept: list[str], kinds: str, make: Callable[[], Callable[[list[str]], dict[str, pa.Array]]], size: int = 4_000_000) -> DataFrame:
    """The kept columns of ``df`` with new ones derived from ``text``; ``make`` is called once a task, ``kinds`` types the new ones.

    An object made may name in ``holds`` what of ``HELD`` it keeps from task to task; all else that the worker holds goes.
    """
    schema = StructType([df.schema[c] for c in kept] + StructType.fromDDL(kinds).fields)

    def run(batches: Batches) -> Batches:
        work = make()
        give_up_all_but(getattr(work, "holds", None))
        for batch in sliced(batches, "text", size):
            yield derived(batch, kept, work(texts_of(batch)))

    return df.mapInArrow(run, schema)
