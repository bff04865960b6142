"""Training features from token ids: shifted inputs and labels, padding, blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE = -100


def input_ids(prompt: Column, output: Column) -> Column:
    return F.concat(prompt, F.slice(output, 1, F.greatest(F.size(output) - 1, F.lit(0))))


def labels(prompt: Column, output: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(IGNORE).cast("long"), F.greatest(F.size(prompt) - 1, F.lit(0))), output)


def fits(prompt: Column, output: Column, most: int) -> Column:
    return (F.size(prompt) > 0) & (F.size(output) > 0) & (F.size(prompt) + F.size(output) - 1 <= most)


def padded(ids: Column, size: int, fill: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(fill).cast("long"), F.greatest(F.lit(size) - F.size(ids), F.lit(0))))


def blocks(ids: Column, size: int) -> Column:
    """(x, y) pairs of ``size`` ids, y one place on; what doesn't fill a block is left."""
    n = F.floor((F.size(ids) - 1) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct(F.slice(ids, i * size + 1, F.lit(size)).alias("x"), F.slice(ids, i * size + 2, F.lit(size)).alias("y")))).otherwise(
        F.array().cast("array<struct<x:array<bigint>,y:array<bigint>>>")
    )
