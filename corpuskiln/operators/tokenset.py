"""Token data sets: encoded segments as one stream, repeated if too short, cut into training and validation, in blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from hashlib import md5
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..session import stored
from . import build, stream

WORD = r"[^ \t\r\n\x0B\f]+"


class TokenizerFile:
    """A tokenizer of the ``tokenizers`` library, by its file; the library is needed only where it is used."""

    def __init__(self, path: str):
        self.path = path

    @cached_property
    def _library(self) -> Any:
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.no_padding()
        found.no_truncation()
        return found

    @property
    def vocab_size(self) -> int:
        return self._library.get_vocab_size()

    def token_to_id(self, token: str) -> int | None:
        return self._library.token_to_id(token)

    def save(self, path: str) -> None:
        self._library.save(path)

    def encode(self, text: str) -> list[int]:
        return self._library.encode(text, add_special_tokens=False).ids

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self._library.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: list[int]) -> str:
        return self._library.decode(ids, skip_special_tokens=False)


def library_ids(rows: DataFrame, path: str, text: str = "text", into: str = "ids", at_once: int = 64) -> DataFrame:
    """``rows`` with the ids (array of int) of each whole text by a tokenizer file, which each task loads once; null texts give none."""
    schema = StructType(list(rows.schema.fields)).add(into, ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = TokenizerFile(path)
        for whole in batches:
            for start in range(0, whole.num_rows, at_once):
                batch = whole.slice(start, at_once)
                ids = tokenizer.encode_all([t or "" for t in batch.column(text).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names, into])

    return rows.mapInArrow(run, schema)


def hashed_ids(text: Column, vocab_size: int, mark: str = stream.MARK) -> Column:
    """Ids of a text's words without a vocabulary: 16 bits of a word's MD5 modulo ``vocab_size`` - 1, plus 1; the mark is 0."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    return F.transform(words, lambda w: F.when(w == mark, 0).otherwise(F.conv(F.substring(F.md5(w.cast("binary")), 1, 4), 16, 10).cast("int") % (vocab_size - 1) + 1))


#: Words whose ids a task keeps at hand.
KNOWN_WORDS = 1 << 18


class _WordIds(dict):
    """Ids of words as ``hashed_ids`` gives them, kept for the next time."""

    def __init__(self, vocab_size: int, mark: str):
        super().__init__()
        self.vocab_size, self.mark = vocab_size, mark

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = found = 0 if word == self.mark else int.from_bytes(md5(word.encode()).digest()[:2], "big") % (self.vocab_size - 1) + 1
        return found


def word_ids(rows: DataFrame, texts: dict[str, str], vocab_size: int, mark: str = stream.MARK) -> DataFrame:
    """``rows`` with the ids of ``hashed_ids`` in place of texts: ``texts`` names the text of each new column; null texts give none.

    Every text is searched once, whatever the ids are used for; in an expression it would be searched for each use.
    """
    kept = [f for f in rows.schema.fields if f.name not in texts.values()]
    schema = StructType([*kept, *[StructField(into, ArrayType(IntegerType())) for into in texts]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, words = _WordIds(vocab_size, mark), re.compile(WORD)
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                columns = [batch.column(f.name) for f in kept]
                for text in texts.values():
                    columns.append(pa.array([[known[w] for w in words.findall(t or "")] for t in batch.column(text).to_pylist()], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(run, schema)


def in_range(ids: Column, vocab_size: int) -> Column:
    """``ids``, or an error if one isn't below ``vocab_size``."""
    most = F.array_max(ids)
    message = F.concat(F.lit("token id "), most.cast("string"), F.lit(f" is not below the vocabulary size {vocab_size}"))
    return F.when(most >= vocab_size, F.raise_error(message).cast("array<int>")).otherwise(ids)


@dataclass(frozen=True)
class TokenSet:
    """``pieces`` (split, start, ids) of both splits, whose ids stand one after the other, and what is known of them."""

    pieces: DataFrame
    metadata: dict[str, Any]

    def blocks(self) -> DataFrame:
        """split, block, x, y: successive windows of a split, y one place on; a window may go on over many pieces.

        A piece gives each block that it touches its share, in one expression, so a long one costs its own length; shares
        of a block meet by (split, block), at most a block's length of them.
        """
        size = self.metadata["block_size"]
        whole = F.when(F.col("split") == "train", F.lit((self.metadata["train_token_count"] - 1) // size)).otherwise(F.lit((self.metadata["val_token_count"] - 1) // size))
        some = self.pieces.where(F.size("ids") > 0).withColumns({"stop": F.col("start") + F.size("ids"), "first": F.greatest(F.lit(0), F.floor((F.col("start") - 1) / size)), "whole": whole})
        some = some.withColumn("last", F.least(F.floor((F.col("stop") - 1) / size), F.col("whole") - 1)).where("first <= last")
        share = lambda b: F.struct(b.alias("block"), F.greatest("start", b * size).alias("at"), F.slice("ids", (F.greatest(F.col("start"), b * size) - F.col("start") + 1).cast("int"), (F.least(F.col("stop"), b * size + size + 1) - F.greatest(F.col("start"), b * size)).cast("int")).alias("ids"))
        shares = some.select("split", F.explode(F.transform(F.sequence("first", "last"), share)).alias("s")).select("split", "s.*").where(F.size("ids") > 0)
        met = shares.groupBy("split", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda s: s["ids"])).alias("ids"))
        return met.select("split", "block", F.slice("ids", 1, size).alias("x"), F.slice("ids", 2, size).alias("y"))


def _streamed(segments: DataFrame, order: list[str], block_size: int) -> tuple[DataFrame, int, int]:
    """Pieces (start, ids) of a stream, its length after repeating, and how often it is repeated."""
    # stored, as the bounds of ranges are taken from a pass of their own
    encoded = stored(segments.select(*order, "ids", F.size("ids").alias("n")))
    placed = stream.running_sum(encoded, order, "n", "start").select("start", "ids")
    n = placed.agg(F.max(F.col("start") + F.size("ids"))).collect()[0][0] or 0
    if not n:
        raise ValueError("the input gives no tokens")
    times = build.repeats(n, block_size)
    if times > 1:
        placed = placed.select("start", "ids", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("time")).select((F.col("start") + F.col("time") * n).alias("start"), "ids")
    return placed, n * times, times


def prepare(segments: DataFrame, order: list[str], block_size: int = 256, val_fraction: float = 0.1, vocab_size: int = 1 << 16, val_segments: DataFrame | None = None) -> TokenSet:
    """The token set of ``segments`` (columns ``order``, unique together, and ids) in their order.

    The last tokens are kept for validation, so many as ``build.tail_split`` says, wherever in a segment the cut falls;
    with ``val_segments`` those are, and nothing is cut.  A stream too short for a block of each split is repeated.  An
    id that isn't below ``vocab_size``, no tokens at all, or too few to split are errors.
    """
    if not 0 < val_fraction < 1:
        raise ValueError("val_fraction must lie between 0 and 1")
    if block_size < 1:
        raise ValueError("block_size must be positive")
    checked = lambda s: s.withColumn("ids", in_range(F.col("ids"), vocab_size))
    train, total, times = _streamed(checked(segments), order, block_size)
    if val_segments is not None:
        val, val_count, val_times = _streamed(checked(val_segments), order, block_size)
        pieces, train_count = train.select(F.lit("train").alias("split"), "start", "ids").unionByName(val.select(F.lit("val").alias("split"), "start", "ids")), total
    else:
        val_count, val_times = build.tail_split(total, block_size, val_fraction), 1
        train_count = total - val_count
        stop, cut = F.col("start") + F.size("ids"), F.lit(train_count)
        side = lambda name, start, a, b: F.struct(F.lit(name).alias("split"), start.cast("long").alias("start"), F.slice("ids", (a - F.col("start") + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")).alias("ids"))
        sides = F.array(side("train", F.col("start"), F.col("start"), F.least(stop, cut)), side("val", F.greatest(F.col("start") - cut, F.lit(0)), F.greatest(F.col("start"), cut), stop))
        pieces = train.select(F.explode(sides).alias("s")).select("s.*").where(F.size("ids") > 0)
    metadata = {
        **{"block_size": block_size, "vocab_size": vocab_size, "dtype": "uint16", "val_fraction": val_fraction},
        **{"train_token_count": train_count, "val_token_count": val_count, "train_repeat_factor": times, "val_repeat_factor": val_times},
        **{"validation_mode": "split" if val_segments is None else "separate_file", "val_fraction_used_for_split": val_segments is None},
    }
    return TokenSet(pieces, metadata)
