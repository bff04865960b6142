"""Operator 12: vector code compression, a byte for each part of a vector.

A vector's components become integers floor(scale * x) and the vector is cut into equal parts.  Each part position has a
codebook of at most 256 entries; a part's code is the index of its nearest entry by squared Euclidean distance, ties to
the lower index.  Codebooks start as the parts of the vectors of least id and move in rounds: all parts are assigned,
and each used entry becomes the componentwise floor of its parts' mean.

Nearest entries are found by a vantage-point tree over the entries of a part position.  A node holds one entry and, for
the nearer and the farther half of the rest, the least and the largest distance to it.  By the triangle inequality that
bounds how near a half's entries can be; a half is skipped only if its bound lies beyond the best distance so far.
Distances are rounded so that bounds only get looser (radii outwards, bounds downwards, the best distance upwards), and
a bound equal to the best is visited, as a tie may lie there with a lower index.  What decides is the squared distance
in integers.  A batch of parts goes through the tree together, each row along its own branches.

Sums and counts of a round are added up in each task over what it reads, then by Spark for each (part, entry): rows by
the parameters, not by the table.  Codebooks (parts x entries rows) are the only thing that reaches the driver.

Defined results: rows whose vector is null or holds null, infinite or not-a-number components go; a row with a null id
is coded, and gives codebooks their start after all others; repeated ids are ordered by their components, repeated rows
get equal results; null labels count as one label.  A vector that can't be cut like the others (empty, a length that
isn't a multiple of the parts or differs from that of the least kept id's, components of 2**26 and more in absolute
value, whose squares would leave 64 bits) stays, with null code and error, and takes no part in codebooks; an empty
table gives an empty table.  Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, quoted

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components must be smaller: squares of their differences, summed over a part of up to 256 components, stay in 64 bits.
LIMIT = 1 << 26
LEAF = 4
#: Relative slack of a rounded square root and of sums of two: more than the few units in the last place that they can err.
SLACK = 2.0**-48

Book = np.ndarray  # parts x entries x width, 64-bit integers


class VantageTree:
    """Exact nearest entries of one part position for many points at once."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self._build(np.arange(len(entries)))

    def _build(self, own: np.ndarray) -> tuple:
        if len(own) <= LEAF:
            return (own,)
        vantage, rest = own[0], own[1:]
        apart = ((self.entries[rest] - self.entries[vantage]) ** 2).sum(axis=1)
        order = np.argsort(apart, kind="stable")
        halves = []
        for half in (order[: len(order) // 2], order[len(order) // 2 :]):
            least, most = np.sqrt(apart[half[[0, -1]]].astype("f8"))
            halves.append((least * (1 - SLACK), most * (1 + SLACK), self._build(np.sort(rest[half]))))
        return (own[:1], *halves)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each point, ties to the lower index, and its squared distance."""
        self.points, n = points, len(points)
        self.best, self.index = np.full(n, np.iinfo("i8").max), np.zeros(n, "i8")
        if n:
            self._visit(self.root, np.arange(n))
        return self.index, self.best

    def _offer(self, rows: np.ndarray, entry: int) -> np.ndarray:
        apart = ((self.points[rows] - self.entries[entry]) ** 2).sum(axis=1)
        better = (apart < self.best[rows]) | ((apart == self.best[rows]) & (entry < self.index[rows]))
        self.best[rows[better]], self.index[rows[better]] = apart[better], entry
        return apart

    def _visit(self, node: tuple, rows: np.ndarray) -> None:
        own, *halves = node
        apart = [self._offer(rows, entry) for entry in own.tolist()][0]
        if not halves:
            return
        distance = np.sqrt(apart.astype("f8"))
        low, high = distance * (1 - SLACK), distance * (1 + SLACK)
        bounds = [np.maximum(low - most, least - high) for least, most, _ in halves]
        nearer = np.where(bounds[0] <= bounds[1], 0, 1)
        for turn in (0, 1):  # first each row's nearer half, then what the better best leaves of the other
            for half in (0, 1):
                in_turn = nearer == (half if turn == 0 else 1 - half)
                open_rows = rows[in_turn & (bounds[half] * (1 - SLACK) <= np.sqrt(self.best[rows].astype("f8")) * (1 + SLACK))]
                if len(open_rows):
                    self._visit(halves[half][2], open_rows)


def integer_vectors(table: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """id, label, v (array of long): kept rows only, components as integers; v null where a component is too large."""
    vector = quoted(vector_col).cast("array<double>")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    scaled = F.transform(vector, lambda x: F.floor(x * F.lit(float(scale))))
    large = F.exists(vector, lambda x: F.abs(x * F.lit(float(scale))) >= F.lit(float(LIMIT)))
    kept = table.where(vector.isNotNull() & ~F.exists(vector, odd))
    return kept.select(quoted(id_col).alias("id"), quoted(label_col).alias("label"), F.when(~large, scaled).alias("v"))


def _cut(batch: pa.RecordBatch, parts: int, width: int) -> np.ndarray:
    """rows x parts x width of a batch whose vectors all have one length."""
    column = batch.column("v")
    return column.flatten().to_numpy(zero_copy_only=False).astype("i8").reshape(batch.num_rows, parts, width)


def first_book(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Book:
    """The parts of the vectors of least id (``entries`` rows, whatever the table's size)."""
    can = F.size("v") > 0
    least = vectors.where(can & (F.size("v") % parts == 0)).orderBy(F.asc_nulls_last("id"), "v").limit(1).collect()
    if not least:
        return np.zeros((parts, 0, 0), "i8")
    width = len(least[0]["v"]) // parts
    rows = vectors.where(F.size("v") == parts * width).orderBy(F.asc_nulls_last("id"), "v").select("v").limit(entries).collect()
    return np.array([r["v"] for r in rows], "i8").reshape(-1, parts, width).transpose(1, 0, 2).copy()


def moved_book(vectors: DataFrame, book: Book) -> Book:
    """One round: all parts assigned, used entries replaced by the floor of their parts' mean."""
    parts, entries, width = book.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [VantageTree(b) for b in book]
        for batch in batches:
            cut, part, entry, n, sums = _cut(batch, parts, width), [], [], [], []
            for p, tree in enumerate(trees):
                index, _ = tree.nearest(np.ascontiguousarray(cut[:, p]))
                order = np.argsort(index, kind="stable")
                used, starts, counts = np.unique(index[order], return_index=True, return_counts=True)
                part.append(np.full(len(used), p))
                entry.append(used)
                n.append(counts)
                sums.append(np.add.reduceat(cut[order, p], starts, axis=0) if len(used) else np.zeros((0, width), "i8"))
            flat = np.concatenate(sums)
            at = pa.array(np.arange(len(flat) + 1, dtype="i4") * width)
            columns = [pa.array(np.concatenate(x).astype(kind)) for x, kind in ((part, "i4"), (entry, "i4"), (n, "i8"))]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(at, pa.array(flat.ravel()))], ["part", "entry", "n", "s"])

    fits = vectors.where(F.size("v") == parts * width).select("v")
    found = fits.mapInArrow(run, "part int, entry int, n bigint, s array<bigint>")
    sums = [F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    new = book.copy()
    for row in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():  # parts x entries rows at most
        new[row["part"], row["entry"]] = [int(row[f"s{i}"]) // row["n"] for i in range(width)]
    return new


def train_book(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Book:
    if not 1 <= entries <= 256:
        raise ValueError("a code of one byte names 1 to 256 entries")
    book = first_book(vectors, parts, entries)
    for _ in range(rounds if book.size else 0):
        book = moved_book(vectors, book)
    return book


def book_digest(book: Book) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def encoded(vectors: DataFrame, book: Book) -> DataFrame:
    """id, label, code (binary, a byte a part), error (long) of every row; null code and error where a vector doesn't fit."""
    parts, _, width = book.shape
    kept = vectors.select("id", "label", F.when(F.size("v") == parts * width if book.size else F.lit(False), F.col("v")).alias("v"))
    kinds = ", ".join(f"{c} {kept.schema[c].dataType.simpleString()}" for c in ("id", "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [VantageTree(b) for b in book]
        for batch in batches:
            fits = batch.column("v").is_valid().to_numpy(zero_copy_only=False)
            sub = batch.filter(pa.array(fits))
            codes, error = np.zeros((sub.num_rows, parts), "u1"), np.zeros(sub.num_rows, "i8")
            if sub.num_rows:
                cut = _cut(sub, parts, width)
                for p, tree in enumerate(trees):
                    codes[:, p], apart = tree.nearest(np.ascontiguousarray(cut[:, p]))
                    error += apart
            place = pa.array(np.where(fits, np.cumsum(fits) - 1, 0), mask=~fits)
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(parts), sub.num_rows, [None, pa.py_buffer(codes.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), raw.take(place), pa.array(error).take(place)], ["id", "label", "code", "error"])

    return kept.mapInArrow(run, f"{kinds}, code binary, error bigint")


def decoded(codes: DataFrame, book: Book, scale: int = SCALE, code_col: str = "code", into: str = "approximation") -> DataFrame:
    """``codes`` with the vector (array of double) that each code stands for; null codes give null."""
    flat = book / float(scale)

    def vectors(code: pa.Array) -> pa.Array:
        parts, _, width = book.shape
        out = [None if c is None else flat[np.arange(parts), np.frombuffer(c, "u1")].ravel().tolist() for c in code.to_pylist()]
        return pa.array(out, pa.list_(pa.float64()))

    return codes.withColumn(into, F.arrow_udf(vectors, "array<double>")(quoted(code_col)))


def compress(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Book]:
    """id, label, code, error, label_error of every kept row, and the codebooks.

    Codes are written once, as errors are summed by label and the sums joined to the rows; the label of a third of all
    rows is one row of sums, sent to all tasks or, beyond Spark's size for that, joined with its rows split by Spark.
    """
    vectors = integer_vectors(table, id_col, vector_col, label_col)
    book = train_book(vectors, parts, entries, rounds)
    codes = materialize(encoded(vectors, book), "codes")
    sums = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return codes.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").select("id", "label", "code", "error", "label_error"), book


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, book = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(book_digest(book)).alias("codebooks_sha256"))
