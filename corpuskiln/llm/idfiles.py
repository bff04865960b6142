"""Operator 13: token ids in binary files, by canonical length-limited Huffman codes.

``code_lengths`` finds from the global counts of the ids the best code lengths of at most ``limit`` bits (package-merge);
the codes are canonical, so the lengths alone, stored once beside the files, give them back.

A file holds segments one after the other, and a last record with the file's totals.  A segment has whole documents: a
head (its first id's place in the file, documents, ids, blocks, bytes of bits), the documents' ids and lengths, for each block of 128
ids the bit offset where it begins, the bits, and a check sum of all.  Blocks can be decoded independently of each other:
the reader takes all blocks of a segment in lock step, each looking its next bits up in one table that gives id and length.

Ids are stored once as they are encoded, counted from there, sorted by document into ranges (ties of ids by number of ids, hash
and place), and written by Spark's text writer, which takes bytes as they come; file ``part-00000`` has the first
range.  Spark's ``binaryFile`` source reads them back: a file's size is that of a range, which ``FILE_IDS`` bounds on average.  The places of a file's first ids
come from the files' last records, summed over the files before.

Defined results: a null or empty text is the end mark alone; documents with null ids come last; rows that repeat stand
one after the other; very long texts lie whole in a segment of their own; an empty table gives files without segments,
and no rows; other columns, whatever their names, are ignored.  A file that was changed or cut off is an error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import BATCH_BYTES, Bpe, Work, default_path
from .common import give_up_all_but, map_texts, materialize, new_path, quoted, whole_text

END_ID = 2
BLOCK_IDS, SEGMENT_IDS, FILE_IDS = 128, 1 << 18, 1 << 23
#: Longest code; decoding looks up as many bits at once, which lie in 32 bits from any place in a byte.
LIMIT = 18
MAGIC, TAIL = b"CKH1", b"CKHE"
HEAD = "<4sQIIIQ"  # magic, first id's place in the file, documents, ids, blocks, bytes of bits
LAST = "<4sIQQ"  # magic, file, documents, ids
HEAD_BYTES, LAST_BYTES = struct.calcsize(HEAD), struct.calcsize(LAST)


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each symbol's code, 0 where it doesn't occur: package-merge over the counts."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), "u1")
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need codes of more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype("i8")
    taken_from, items = [], leaves
    is_leaf = np.ones(len(leaves), bool)
    for _ in range(limit - 1):
        taken_from.append(is_leaf)
        packages = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, packages])
        by = np.argsort(both, kind="stable")
        items, is_leaf = both[by], by < len(leaves)
    taken_from.append(is_leaf)
    most, bits = 2 * len(leaves) - 2, np.zeros(len(leaves), "i8")
    for is_leaf in reversed(taken_from):  # what is taken of a level: its first items, of which the leaves gain a bit
        found = int(is_leaf[:most].sum())
        bits[:found] += 1
        most = 2 * (most - found)
    lengths[order] = bits
    return lengths


class Codes:
    """Canonical codes of given lengths: shorter first, then by symbol."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype("i8")
        used = np.flatnonzero(lengths)
        order = used[np.argsort(lengths[used], kind="stable")]
        self.limit = int(lengths.max(initial=1))
        room = np.left_shift(np.int64(1), self.limit - self.lengths[order])  # of the code space of ``limit`` bits
        first = np.concatenate([[0], np.cumsum(room)])
        if first[-1] > 1 << self.limit:
            raise ValueError("these lengths are no prefix code")
        self.entries = np.zeros(len(lengths), "u4")  # code << 5 | length, of every symbol
        self.entries[order] = (first[:-1] >> (self.limit - self.lengths[order])) << 5 | self.lengths[order]
        self.table = np.zeros(1 << self.limit, "u4")  # symbol << 5 | length, at every value of the next ``limit`` bits
        self.table[: first[-1]] = np.repeat((order.astype("u4") << np.uint32(5)) | lengths[order].astype("u4"), room)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bits of ``ids``, and the bit offset of every block."""
        entry = self.entries[ids]
        size = (entry & np.uint32(31)).astype("i8")
        ends = np.cumsum(size)
        starts = ends - size
        if not len(ids):
            return b"", starts.astype("u4")
        word, into = starts >> 6, (starts & 63).astype("u8")
        left = (entry >> np.uint32(5)).astype("u8") << (64 - size).astype("u8")  # the code at the top of a word
        words = np.zeros((int(ends[-1]) >> 6) + 2, "u8")
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[first]] = np.add.reduceat(left >> into, first)
        split = np.flatnonzero((ends - 1) >> 6 != word)  # the rest of these goes to the next word
        words[word[split] + 1] += left[split] << (np.uint64(64) - into[split])
        return words.astype(">u8").tobytes()[: (int(ends[-1]) + 7) // 8], starts[::BLOCK_IDS].astype("u4")

    def decode(self, bits: bytes, offsets: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` ids of ``bits``, all blocks in lock step."""
        data = bits + bytes(8 + BLOCK_IDS * 4)
        at = np.ndarray((len(data) - 3,), ">u4", data, strides=(1,))  # the 32 bits from any byte on
        out, place = np.empty((BLOCK_IDS, len(offsets)), "u4"), offsets.astype("i8")
        down = np.uint32(32 - self.limit)
        last = len(at) - 1
        for step in range(BLOCK_IDS if len(offsets) > 1 else min(n, BLOCK_IDS)):
            found = at[np.minimum(place >> 3, last)].astype("u4")
            found <<= (place & 7).astype("u4")
            found >>= down
            entry = self.table[found]
            out[step] = entry >> np.uint32(5)
            place += entry & np.uint32(31)
        return out.T.reshape(-1)[:n]


def segment(codes: Codes, start: int, docs: np.ndarray, known: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of a segment; ``docs`` are the documents' ids (0 where null), ``known`` whether there is one."""
    bits, offsets = codes.encode(ids)
    head = struct.pack(HEAD, MAGIC, start, len(docs), len(ids), len(offsets), len(bits))
    parts = (head, docs.astype("<i8").tobytes(), known.astype("u1").tobytes(), sizes.astype("<u4").tobytes(), offsets.astype("<u4").tobytes(), bits)
    whole = b"".join(parts)
    return whole + struct.pack("<I", zlib.crc32(whole))


def segments(content: memoryview, codes: Codes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """start, docs, known, sizes, ids of each segment of a file, whose last record must agree with them."""
    at, n_docs, n_ids = 0, 0, 0
    while True:
        if bytes(content[at : at + 4]) == TAIL and len(content) >= at + LAST_BYTES:
            _, _, docs, ids = struct.unpack_from(LAST, content, at)
            if (docs, ids) != (n_docs, n_ids):
                raise ValueError("a file lacks segments")
            return
        if len(content) < at + HEAD_BYTES:
            raise ValueError("a file is cut off")
        magic, start, d, n, b, size = struct.unpack_from(HEAD, content, at)
        ends = np.cumsum([HEAD_BYTES, 8 * d, d, 4 * d, 4 * b, size]).tolist()
        whole = content[at : at + ends[-1]]
        if magic != MAGIC or len(content) < at + ends[-1] + 4 or zlib.crc32(whole) != struct.unpack_from("<I", content, at + ends[-1])[0]:
            raise ValueError("a segment was changed or cut off")
        docs, known, sizes, offsets = (np.frombuffer(whole[a:z], kind) for a, z, kind in zip(ends, ends[1:5], ("<i8", "u1", "<u4", "<u4"), strict=False))
        yield start, docs, known.astype(bool), sizes, codes.decode(bytes(whole[ends[4] :]), offsets, n)
        n_docs, n_ids, at = n_docs + d, n_ids + n, at + ends[-1] + 5  # and the line's end


def token_ids(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, n, hash, ids (binary; little-endian, 16 bits each where the vocabulary allows) of every document."""
    path = path or default_path()
    kind = id_kind(path, end_id)
    end = np.array([end_id], "<u4").tobytes()

    def pack(bpe: Bpe, texts: list[str]) -> dict[str, pa.Array]:
        found = [np.frombuffer(x + end, "<u4").astype(kind).tobytes() for x in bpe.packed_all(texts, at_once=True)]
        size = np.dtype(kind).itemsize
        return {"n": pa.array([len(x) // size for x in found], pa.int64()), "hash": pa.array([zlib.crc32(x) for x in found], pa.int64()), "ids": pa.array(found, pa.binary())}

    rows = docs.select(quoted("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return map_texts(rows, ["doc_id"], "n bigint, hash bigint, ids binary", lambda: Work(path, pack), BATCH_BYTES)


def id_kind(path: str, end_id: int) -> str:
    from .bpe import load

    return "<u2" if max(len(load(path).strings), end_id + 1) <= 1 << 16 else "<u4"


def count_ids(stored: DataFrame, kind: str, size: int) -> np.ndarray:
    """How often each id occurs: added up in each task, then by Spark; a row for each id of the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up_all_but(None)
        total = np.zeros(size, "i8")
        for batch in batches:
            ids = batch.column("ids").cast(pa.large_binary())
            _, ends, data = ids.buffers()
            ends = np.frombuffer(ends, "i8")[ids.offset : ids.offset + len(ids) + 1]
            if len(ends) and ends[-1] > ends[0]:
                total += np.bincount(np.frombuffer(data[ends[0] : ends[-1]], kind), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["symbol", "n"])

    counts = np.zeros(size, "i8")
    found = stored.select("ids").mapInArrow(run, "symbol bigint, n bigint").groupBy("symbol").agg(F.sum("n").alias("n"))
    for row in found.collect():
        counts[row["symbol"]] = row["n"]
    return counts


def write_files(stored: DataFrame, path: str, kind: str, lengths: np.ndarray) -> None:
    """Files of ids below ``path`` in ascending order of documents, and the code lengths beside them."""
    spark = stored.sparkSession
    sent = spark.sparkContext.broadcast(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up_all_but(None)
        codes, file = Codes(sent.value), None
        docs, known, sizes, ids, held, n_docs, n_ids = [], [], [], [], 0, 0, 0

        def taken() -> pa.RecordBatch:
            nonlocal docs, known, sizes, ids, held, n_docs, n_ids
            out = segment(codes, n_ids, np.array(docs, "i8"), np.array(known), np.array(sizes), np.concatenate(ids))
            n_docs, n_ids = n_docs + len(docs), n_ids + held
            docs, known, sizes, ids, held = [], [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], ["record"])

        for batch in batches:
            if batch.num_rows:
                file = batch.column("file")[0].as_py()
            for doc, own in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                own = np.frombuffer(own.as_buffer(), kind)
                docs.append(doc or 0)
                known.append(doc is not None)
                sizes.append(len(own))
                ids.append(own)
                held += len(own)
                if held >= SEGMENT_IDS:
                    yield taken()
        if held:
            yield taken()
        if file is not None:
            yield pa.RecordBatch.from_arrays([pa.array([struct.pack(LAST, TAIL, file, n_docs, n_ids)], pa.binary())], ["record"])

    n = stored.agg(F.sum("n")).collect()[0][0] or 0
    files = max(1, -(-n // FILE_IDS))
    placed = stored.withColumn("place", F.monotonically_increasing_id())
    order = [F.asc_nulls_last("doc_id"), F.asc("n"), F.asc("hash"), F.asc("place")]
    ranged = placed.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "ids", F.spark_partition_id().alias("file"))
    ranged.mapInArrow(run, "record binary").select(F.col("record").cast("string")).write.option("lineSep", "\n").text(f"{path}/ids")
    packed = zlib.compress(lengths.tobytes())
    spark.createDataFrame([(packed.hex(),)], "lengths string").coalesce(1).write.text(f"{path}/lengths")


def read_files(spark: SparkSession, path: str, digests: bool = False) -> DataFrame:
    """file, doc_id, start (place in the file), n_tokens, ids (binary, 32 bits each) of every document of the files.

    With ``digests`` the ids stay in the task, and their CRC-32 comes as ids_crc32 in their place.
    """
    lengths = np.frombuffer(zlib.decompress(bytes.fromhex(spark.read.text(f"{path}/lengths").first()[0])), "u1")
    sent = spark.sparkContext.broadcast(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(sent.value)
        for batch in batches:
            for content in batch.column("content"):
                data = memoryview(content.as_buffer())
                if not len(data):
                    continue
                file = struct.unpack_from(LAST, data, len(data) - LAST_BYTES - 1)[1]
                for start, docs, known, sizes, ids in segments(data, codes):
                    ends = np.cumsum(sizes, dtype="i8")
                    raw, at = ids.astype("<u4").tobytes(), np.concatenate([[0], 4 * ends]).astype("i8")
                    if digests:
                        view = memoryview(raw)
                        column = pa.array([zlib.crc32(view[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64())
                    else:
                        column = pa.Array.from_buffers(pa.large_binary(), len(docs), [None, pa.py_buffer(at), pa.py_buffer(raw)]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), file, "i4")), pa.array(docs, mask=~known), pa.array(start + ends - sizes), pa.array(sizes.astype("i8")), column], names)

    names = ["file", "doc_id", "start", "n_tokens", "ids_crc32" if digests else "ids"]
    return _contents(spark, path).mapInArrow(run, f"file int, doc_id bigint, start bigint, n_tokens bigint, {'ids_crc32 bigint' if digests else 'ids binary'}")


def _contents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/ids").select("content")


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """file, before: the ids of all files before each, from the files' last records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = [struct.unpack_from(LAST, x.as_buffer()) for x in batch.column("last")]
            yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in last], pa.int32()), pa.array([x[3] for x in last], pa.int64())], ["file", "n"])

    last = _contents(spark, path).where(F.octet_length("content") > 0).select(F.expr(f"substring(content, -{LAST_BYTES + 1}, {LAST_BYTES})").alias("last"))
    found = last.mapInArrow(run, "file int, n bigint")
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.select("file", before.alias("before"))


def store_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encode all documents and write their ids below ``path``."""
    tokenizer = tokenizer or default_path()
    kind = id_kind(tokenizer, end_id)
    stored = materialize(token_ids(docs, tokenizer, end_id), "ids")
    size = 1 << 16 if kind == "<u2" else 1 + max(_vocabulary(tokenizer), end_id)
    write_files(stored, path, kind, code_lengths(count_ids(stored, kind, size)))


def _vocabulary(path: str) -> int:
    from .bpe import load

    return len(load(path).strings)


def op13_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "idfiles")
    store_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_files(spark, path, digests=True).join(file_starts(spark, path), "file").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
