"""Operator 4: best-fit packing by minimum bin slack.

Documents become token ids and an end mark; only those longer than a sequence are cut.  Which lengths share a sequence
is decided on the histogram of lengths alone, at most ``capacity`` rows however large the corpus: take the largest
length left, find by a bitset subset-sum dynamic programme over the available lengths the fullest feasible
combination for the rest of the bin, remove it, as many times over as the counts allow, and go on.  Each application
leaves some length with fewer copies than the combination used of it, so the number of different combinations is
bounded by the capacity (the sum over lengths of capacity / length), not by the corpus.  Pieces then find their places
by rank within their length; ranks are taken within salted parts of a length, so a length that a third of all pieces
share is spread over many tasks.

Tokens are those of the BPE operator, whose tables are shared; words new to them are merged a batch at a time, as arrays.

Defined results: a null or empty text is the end mark alone; a very long text becomes as many pieces as it takes; an
empty table packs to an empty table; rows that repeat are packed each on its own; ties (pieces of equal id and content)
are interchangeable; null ids and ids of any size come back as they are; ``pack_documents`` ignores other columns and
``pack_lengths`` keeps them, whatever their names (a ``sequence_id`` or ``offset`` among them is replaced); a null
length, or one over the capacity or below 1, given to ``pack_lengths`` is an error.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import BATCH_BYTES, Bpe, Work, default_path
from .common import map_texts, materialize, quoted, whole_text

CAPACITY = 4096
END_ID = 1
#: Pieces that one window partition may hold on average if all had one length.
RANK_ROWS = 200_000


def fullest(counts: dict[int, int], target: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum up to ``target``."""
    reach, mask, steps = 1, (2 << target) - 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= target), reverse=True):
        left, chunk = min(counts[length], target // length), 1
        while left:
            chunk = min(chunk, left)
            steps.append((length, chunk, reach))
            reach |= (reach << (length * chunk)) & mask
            left -= chunk
            chunk *= 2
        if reach >> target & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, chunk, before in reversed(steps):
        if not before >> total & 1:
            total -= length * chunk
            used[length] = used.get(length, 0) + chunk
    return used


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: copies in a bin}) until every length is used up."""
    counts, bins = {x: n for x, n in histogram.items() if n}, []
    while counts:
        largest = max(counts)
        counts[largest] -= 1
        used = fullest(counts, capacity - largest)
        counts[largest] += 1
        used[largest] = used.get(largest, 0) + 1
        times = min(counts[x] // n for x, n in used.items())
        bins.append((times, used))
        for x, n in used.items():
            counts[x] -= times * n
            if not counts[x]:
                del counts[x]
    return bins


def places(bins: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """For each length and run of ranks: how many lie in a bin, the first bin, the offset; sorted by (length, rank)."""
    rows, taken, sequence = [], {}, 0
    for times, used in bins:
        offset = 0
        for length, copies in sorted(used.items(), reverse=True):
            start = taken.get(length, 0)
            rows.append((length << 44 | start, start, copies, sequence, offset))
            taken[length] = start + times * copies
            offset += length * copies
        sequence += times
    table = np.array(sorted(rows), dtype="i8").reshape(-1, 5)
    return dict(zip(("key", "start", "copies", "sequence", "offset"), table.T.copy(), strict=True))


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces."""
    path = path or default_path()
    end = np.array([end_id], "<u4").tobytes()

    def cut(bpe: Bpe, texts: list[str]) -> dict[str, pa.Array]:
        firsts, lengths, crcs = [0], [], []
        for ids in bpe.packed_all(texts, at_once=True):
            packed = ids + end
            for start in range(0, len(packed), 4 * capacity):
                piece = packed[start : start + 4 * capacity]
                lengths.append(len(piece) // 4)
                crcs.append(zlib.crc32(piece))
            firsts.append(len(lengths))
        pieces = pa.StructArray.from_arrays([pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], ["length", "crc"])
        return {"pieces": pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), pieces)}

    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    found = map_texts(rows, ["doc_id"], "pieces array<struct<length:bigint,crc:bigint>>", lambda: Work(path, cut), BATCH_BYTES)
    cuts = found.select("doc_id", F.posexplode("pieces").alias("piece", "x"))
    return cuts.select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("start"), "x.length", F.col("x.crc").alias("ids_crc32"))


def pack_lengths(pieces: DataFrame, keys: list[str], capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """``pieces`` (stored, so that both passes see the same rows) with sequence_id and offset."""
    spark = pieces.sparkSession
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    kept = pieces.select(quoted(length_col).cast("long").alias("length"), F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(names)]).alias("row"), F.struct(*[quoted(c).alias(f"k{i}") for i, c in enumerate(keys)]).alias("key"))
    counted = kept.groupBy("length").agg(F.count("*").alias("n"))
    found = counted.where(~F.coalesce(F.col("length").between(1, capacity), F.lit(False))).limit(1).collect()
    if found:
        raise ValueError(f"length {found[0]['length']} doesn't lie between 1 and {capacity}")
    histogram = {r["length"]: r["n"] for r in counted.collect()}  # at most ``capacity`` rows
    total = sum(histogram.values())
    table = spark.sparkContext.broadcast(places(minimum_bin_slack(histogram, capacity)))
    salts = max(256, -(-total // RANK_ROWS))
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)))
    ranked = salted.withColumn("place", F.row_number().over(Window.partitionBy("length", "salt").orderBy("key")))
    before = (
        salted.groupBy("length", "salt")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    )
    joined = ranked.join(before, ["length", "salt"]).select("length", (F.col("before") + F.col("place") - 1).alias("rank"), "row")
    kind = joined.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(t["key"], length << 44 | rank, side="right") - 1
            into = rank - t["start"][at]
            copies = t["copies"][at]
            new = [t["sequence"][at] + into // copies, t["offset"][at] + into % copies * length]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *[pa.array(x, pa.int64()) for x in new]], ["row", "sequence_id", "offset"])

    out = joined.mapInArrow(run, f"row {kind}, sequence_id long, offset long")
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)], "sequence_id", "offset")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialize(token_pieces(docs, capacity, path, end_id), "pieces")
    return pack_lengths(pieces, ["doc_id", "piece", "start", "ids_crc32"], capacity)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
