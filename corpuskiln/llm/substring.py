"""Operator 9: substring dedup by difference-cover anchors.

A window is ``window`` consecutive words.  A difference cover D of a period v has, for any two places i and j, a shift
below v that brings both onto D; so two equal windows share an equal anchor of ``window - v + 1`` words at places that
both lie on D.  Only anchors at those places are hashed and shuffled (5 of every 21 for windows of 35 words).  Anchors
that occur twice are then extended: the windows around them, and no others, are hashed in full, and windows are taken
for equal if their 96-bit hashes are (texts if their 96 bits of two hashes are).

Equal texts are brought together first, one row a text with the number of its copies (a task sends each text once):
all windows of a text with copies are repeats, and only distinct texts are searched for shared windows.

Skew: each task first combines its own equal hashes, so a passage that a third of all documents hold reaches the
shuffle once a task, not once an occurrence.  The last join, by text, has no aggregation over it, so adaptive execution
may split a text with very many copies over tasks.

Defined results: null and empty texts have no words; texts shorter than a window lose nothing; very long texts are
hashed whole, in blocks; repeated rows are occurrences of their own, so all their windows are removed (ties: every
occurrence goes); ids are not looked at, and null ones and ids of any size come back as they are; other columns,
whatever their names, pass through ``remove_repeats`` unchanged (``n_chars`` follows the text); a text that loses
nothing is unchanged, a null one stays null, else kept words are joined by one space; an empty table gives an empty
table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SetAside, materialize, release, sliced, texts_of, whole_text
from .words import OTHER_BASE, WHITE, mix, run_hashes, word_hashes

WINDOW = 35
#: Perfect difference sets by period: fixed values.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27), 57: (0, 1, 6, 15, 22, 26, 45, 55)}
#: Shortest anchor, in words: shorter ones are often equal without a window around them, and each calls for a period of windows.
LEAST_ANCHOR = 12
#: Hashes that a task combines at once.
COMBINE = 2_000_000
#: In the place of starts: every window of the text occurs elsewhere too.
ALL = -1


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The largest period whose anchors are long enough; for short windows each place is one."""
    return max(((v, d) for v, d in COVERS.items() if window - v + 1 >= LEAST_ANCHOR), default=(1, (0,)))


def _combined(h1: np.ndarray, h2: np.ndarray, quiet: np.ndarray, more: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Rows (h1, h2, n, ...) for a shuffle that counts each hash; kept narrow, as there may be one for each word.

    A hash that occurs once here keeps its place (n = 1); one that occurs more often is sent once, without a place
    (n = -2), and its places go along as known repeats, each under a key of its own (n = 2).  Where ``quiet``, a hash
    counts for others but its place is not asked for (n = -1).
    """
    n = len(h1)
    order = np.lexsort((h2, h1))
    same = (h1[order[1:]] == h1[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]])
    first, last = np.concatenate([np.ones(min(n, 1), bool), ~same]), np.concatenate([~same, np.ones(min(n, 1), bool)])
    repeated = np.zeros(n, bool)
    repeated[order] = ~(first & last)
    once, known, sent = np.flatnonzero(~repeated), np.flatnonzero(repeated & ~quiet), order[first & ~last]
    rows = np.concatenate([once, known, sent])
    a, b = h1[rows], h2[rows]
    a[len(once) : len(once) + len(known)] = mix(h1[known] ^ mix(known.astype("u8") + np.uint64(1)))
    count = np.concatenate([np.where(quiet[once], -1, 1), np.full(len(known), 2), np.full(len(sent), -2)]).astype("i1")
    columns = {"h1": a.view("i8"), "h2": b.view("i4"), "n": count} | {k: v[rows] for k, v in more.items()}
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], list(columns))


def _repeated(rows: DataFrame) -> DataFrame:
    """The placed rows whose hash occurs elsewhere too."""
    return rows.withColumn("total", F.sum(F.abs("n")).over(Window.partitionBy("h1", "h2"))).where("total >= 2 AND n > 0")


def _places(firsts: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.arange(n) - firsts[:-1][doc]


def distinct_texts(docs: DataFrame) -> DataFrame:
    """key, key2 (64 and 32 bits of hash), copies, text: a row for each distinct text."""
    text = whole_text()
    keyed = docs.select(F.xxhash64(text).alias("key"), F.hash(text).alias("key2"), text.alias("text"))
    return materialize(keyed.groupBy("key", "key2").agg(F.count("*").alias("copies"), F.first("text").alias("text")), "texts", large=True)


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype("i8")


def _where(batch: pa.RecordBatch, doc: np.ndarray, place: np.ndarray) -> dict[str, np.ndarray]:
    """The text (key, and key2 in the upper half of place) and place of each hash, as narrow columns."""
    return {"key": _numbers(batch, "key")[doc], "place": _numbers(batch, "key2")[doc] << 32 | place}


def _anchors(texts: DataFrame, window: int) -> DataFrame:
    """key, key2, place of every anchor that occurs elsewhere too among distinct texts."""
    period, cover = cover_for(window)
    length = window - period + 1
    on = np.zeros(period, bool)
    on[list(cover)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h, k, p = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            return _combined(h, np.zeros(len(h), "u4"), np.zeros(len(h), bool), {"key": k, "place": p})

        for batch in sliced(batches):
            words, firsts = word_hashes([t.encode() for t in texts_of(batch)], WHITE)
            hashes = run_hashes(words, length)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(firsts))[: len(hashes)]
            place = _places(firsts, doc, len(hashes))
            # an anchor serves only if some whole window of its document holds it
            at = np.flatnonzero(on[place % period] & (place + length <= np.diff(firsts)[doc]) & (np.diff(firsts)[doc] >= window))
            where = _where(batch, doc[at], place[at])
            held.append((hashes[at], where["key"], where["place"]))
            size += len(at)
            if size >= COMBINE:
                size = 0
                yield flush()
        if held:
            yield flush()

    return _placed(_repeated(texts.select("key", "key2", "text").mapInArrow(run, "h1 long, h2 int, n byte, key long, place long")))


def _placed(rows: DataFrame) -> DataFrame:
    return rows.select("key", F.shiftright("place", 32).cast("int").alias("key2"), F.col("place").bitwiseAND((1 << 31) - 1).cast("int").alias("place"))


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """key, key2, starts: of each distinct text, the windows whose words occur elsewhere too (ALL: each one)."""
    period, _ = cover_for(window)
    texts = distinct_texts(docs)
    near = materialize(_anchors(texts, window).groupBy("key", "key2").agg(F.collect_list("place").alias("places")), "anchors", large=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h1, h2, quiet, key, place = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            return _combined(h1, h2, quiet, {"key": key, "place": place})

        for batch in sliced(batches):
            words, firsts = word_hashes([t.encode() for t in texts_of(batch)], WHITE)
            steps = np.zeros(len(words) + 1, "i4")
            for i, places in enumerate(batch.column("places")):
                p = firsts[i] + places.values.to_numpy(zero_copy_only=False).astype("i8")
                np.add.at(steps, np.maximum(p - period + 1, firsts[i]), 1)
                np.add.at(steps, p + 1, -1)
            h1, h2 = run_hashes(words, window), run_hashes(words, window, OTHER_BASE)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(firsts))[: len(h1)]
            place = _places(firsts, doc, len(h1))
            at = np.flatnonzero((np.cumsum(steps)[: len(h1)] > 0) & (place + window <= np.diff(firsts)[doc]))
            where = _where(batch, doc[at], place[at])
            held.append((h1[at], (h2[at] >> np.uint64(32)).astype("u4"), _numbers(batch, "copies")[doc[at]] > 1, where["key"], where["place"]))
            size += len(at)
            if size >= COMBINE:
                size = 0
                yield flush()
        if held:
            yield flush()

    found = texts.join(near, ["key", "key2"]).select("key", "key2", "copies", "text", "places").mapInArrow(run, "h1 long, h2 int, n byte, key long, place long")
    shared = materialize(_placed(_repeated(found)).groupBy("key", "key2").agg(F.collect_list("place").alias("starts")), "windows", large=True)
    return shared.unionByName(texts.where("copies > 1").select("key", "key2", F.array(F.lit(ALL)).alias("starts")))


def _with_starts(rows: DataFrame, window: int) -> DataFrame:
    """``rows`` (row, text) with starts (null if no window repeats)."""
    found = repeated_windows(rows, window).withColumnsRenamed({"key": "at", "key2": "at2"})
    release(rows.sparkSession)
    joined = rows.join(found, (F.xxhash64(whole_text()) == F.col("at")) & (F.hash(whole_text()) == F.col("at2")), "left")
    return joined.select("row", "text", "starts")


def _kept(words: list[bytes], starts: np.ndarray, window: int) -> list[bytes]:
    if starts[0] == ALL:
        starts = np.arange(len(words) - window + 1)
    steps = np.zeros(len(words) + 1, "i4")
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + window, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(steps)[:-1] == 0)]


def _starts(batch: pa.RecordBatch) -> list[np.ndarray | None]:
    return [x.values.to_numpy(zero_copy_only=False).astype("i8") if x.is_valid else None for x in batch.column("starts")]


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the words of windows that occur elsewhere too; n_chars, where present, follows."""
    aside = SetAside.of(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            new: list[str | None] = []
            for text, starts in zip(texts_of(batch), _starts(batch), strict=True):
                words = [] if starts is None else text.encode().split()
                kept = words if starts is None else _kept(words, starts, window)
                new.append(None if len(kept) == len(words) else b" ".join(kept).decode())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), pa.array(new, pa.string())], ["row", "text", "new"])

    joined = _with_starts(aside.rows, window)
    done = joined.mapInArrow(run, f"row {joined.schema['row'].dataType.simpleString()}, text string, new string")
    return aside.back(done.select("row", F.coalesce("new", "text").alias("text")), text_changed=True)


def removal_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            total, removed, digests = [], [], []
            for text, starts in zip(texts_of(batch), _starts(batch), strict=True):
                words = text.encode().split()
                kept = words if starts is None else _kept(words, starts, window)
                total.append(len(words))
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], ["row", "n_words", "n_removed", "kept_sha256"])

    joined = _with_starts(docs.select(F.col("doc_id").cast("long").alias("row"), whole_text().alias("text")), window)
    return joined.mapInArrow(run, "row long, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("row", "doc_id")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
