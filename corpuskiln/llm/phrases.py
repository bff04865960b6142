"""Operator 11: phrase collocation mining by level-wise Apriori passes.

Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and pieces into words at spaces and tabs.
Level 1 counts words.  Level k is one more pass over the texts: the frequent (k-1)-grams of the level before are sent to
all tasks, a k-gram is emitted only where both of its overlapping (k-1)-grams are frequent, and the emitted are counted.
Candidates are then scored from the level tables alone: each cut of a phrase looks its two parts up in their levels.

What is sent to the tasks is a bit table of the frequent grams' hashes, 16 bits a gram and 32 MB at most, whatever the
corpus.  A gram that is not frequent may pass it by chance, and passes more often where the table is full; its k-grams
are then counted in vain, fall under the least count like any others, and change no result: a frequent k-gram's parts are frequent
too, so none is lost.  Words themselves are counted as strings, never by hash.

Counts come from arrays a batch at a time: words are numbered by Arrow, k-grams are pairs of numbers.  A batch gives one
row for each different gram, which Spark adds up by key, words before the shuffle too, so a word or phrase that fills a
third of the corpus is one row a batch.  The first of each language are found by a sort into ranges, of which only the leading ones
of each language are ranked.

Arithmetic is in decimals of 38 digits, exact for counts up to 10**16.

Defined results: a null language counts as ``und``; null and empty texts, and texts of separators alone, give nothing;
very long texts are taken whole; repeated rows count as often as they stand; other columns, whatever their names, are
ignored; ties in score and count go to the phrase that comes first by its bytes; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_up_all_but, materialize, quoted, sliced, whole_text
from .words import mix, word_hashes

MOST_WORDS, LEAST_COUNT, TOP, COVER = 3, 10, 2000, 50
#: Bits of the table of frequent grams: so many a gram, within these bounds (a bucket of Spark's bitmaps is 2**15 bits).
BITS_A_GRAM, LEAST_BITS, MOST_BITS, BUCKET = 16, 1 << 15, 1 << 28, 1 << 15
BATCH_BYTES = 4_000_000

_LOWER = np.arange(256, dtype="u1")
_LOWER[65:91] += 32
_WORD, _SPACE, _BREAK = 0, 1, 2
_KIND = np.zeros(256, "u1")
_KIND[list(b" \t")] = _SPACE
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = _BREAK
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _language_hash(languages: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in languages], "u8")


def gram_hashes(languages: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hash of each row of ``words`` (hashes, rows x places) in its language."""
    out = languages
    for place in range(words.shape[1]):
        out = mix(out * _STEP + words[:, place])
    return out


class FrequentBits:
    """The bit table of one level's frequent grams, as tasks hold it."""

    def __init__(self, bits: int, table: bytes):
        self.mask, self.table = np.uint64(bits - 1), np.frombuffer(table, "u1")

    @staticmethod
    def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        return hashes & np.uint64(bits - 1), (hashes >> np.uint64(32)) & np.uint64(bits - 1)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for place in self.places(hashes, int(self.mask) + 1):
            found &= (self.table[(place >> np.uint64(3)).astype("i8")] >> (place & np.uint64(7)).astype("u1") & 1).astype(bool)
        return found


class Batch:
    """The words of a batch of texts as numbers."""

    def __init__(self, texts: pa.Array, languages: pa.Array):
        texts = texts.cast(pa.large_binary())
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, "i8")[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, "i8")
        raw = np.frombuffer(data, "u1")[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, "u1")
        ends = ends - ends[0]
        kind = _KIND[raw]
        word = kind == _WORD
        edge = np.zeros(len(raw) + 1, bool)
        edge[ends] = True  # no word crosses from text to text
        starts = np.flatnonzero(word & (edge[:-1] | ~np.concatenate([[False], word[:-1]])))
        stops = np.flatnonzero(word & (edge[1:] | ~np.concatenate([word[1:], [False]]))) + 1
        offsets = np.concatenate([[0], np.cumsum(stops - starts)])
        found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[raw[word]])]).dictionary_encode()
        self.dictionary = found.dictionary
        text = np.searchsorted(ends, starts, side="right") - 1
        breaks = np.cumsum(kind == _BREAK, dtype="i4")[starts]
        #: Whether a word and the next lie in one piece.
        self.linked = (text[1:] == text[:-1]) & (breaks[1:] == breaks[:-1])
        spoken = languages.dictionary_encode()
        self.languages = spoken.dictionary
        #: Words of different languages are different: ``owns`` numbers them, ``kinds`` has (language, dictionary) of each.
        size = max(1, len(self.dictionary))
        kinds, self.owns = np.unique(spoken.indices.to_numpy()[text].astype("i8") * size + found.indices.to_numpy(), return_inverse=True)
        self.kinds = np.stack([kinds // size, kinds % size])

    def hashes(self, owns: np.ndarray) -> np.ndarray:
        """Hashes of grams given as rows of ``owns`` numbers."""
        words, _ = word_hashes(self.dictionary.to_pylist())
        return gram_hashes(_language_hash(self.languages.to_pylist())[self.kinds[0, owns[:, 0]]], words[self.kinds[1, owns]])

    def grams(self, k: int, frequent: FrequentBits | None) -> tuple[np.ndarray, np.ndarray]:
        """The different k-grams, as rows of ``owns`` numbers, and their counts; both (k-1)-grams of each may be frequent."""
        size = max(1, len(self.kinds[0]))
        at, number, first = np.arange(len(self.owns)), self.owns, None
        for n in range(2, k + 1):  # numbers of n-grams from those of (n-1)-grams: where one begins, and the next word
            if n == k:
                may = frequent.may_hold(self.hashes(self._rows(at[first], n - 1) if first is not None else np.arange(size)[:, None]))[number]
                number, at = number[may], at[may]
            follows = at[1:] == at[:-1] + 1  # the (n-1)-gram that begins one word on
            at, keys = at[:-1][follows], number[:-1][follows] * size + self.owns[at[:-1][follows] + n - 1]
            if n == 2:
                at, keys = at[self.linked[at]], keys[self.linked[at]]
            if n < k:
                _, first, number = np.unique(keys, return_index=True, return_inverse=True)
            else:
                _, first, counts = np.unique(keys, return_index=True, return_counts=True)
                return self._rows(at[first], n), counts
        return np.arange(size)[:, None][: len(self.kinds[0])], np.bincount(self.owns, minlength=len(self.kinds[0]))

    def _rows(self, at: np.ndarray, n: int) -> np.ndarray:
        return self.owns[at[:, None] + np.arange(n)]

    def columns(self, rows: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Language and phrase of grams."""
        words = self.dictionary.cast(pa.large_string())
        parts = [words.take(pa.array(self.kinds[1, rows[:, place]])) for place in range(rows.shape[1])]
        phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if len(parts) > 1 else parts[0]
        return self.languages.take(pa.array(self.kinds[0, rows[:, 0]])), phrase.cast(pa.string())


def level(texts: DataFrame, k: int, least: int, frequent: FrequentBits | None = None) -> DataFrame:
    """lang, phrase, f of the k-grams of ``texts`` (lang, text) counted at least ``least`` times.

    On level 1 a row with null phrase has the number of all words of a language.
    """
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast((int(frequent.mask) + 1, frequent.table.tobytes())) if frequent else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up_all_but(None)
        bits = FrequentBits(*sent.value) if sent else None
        for batch in sliced(batches, "text", BATCH_BYTES):
            own = Batch(batch.column("text"), batch.column("lang"))
            if not len(own.owns):
                continue
            rows, counts = own.grams(k, bits)
            lang, phrase = own.columns(rows)
            yield pa.RecordBatch.from_arrays([lang, phrase, pa.array(counts.astype("i8"))], ["lang", "phrase", "f"])
            if k == 1:
                all_words = np.bincount(own.kinds[0], weights=counts, minlength=len(own.languages)).astype("i8")
                yield pa.RecordBatch.from_arrays([own.languages, pa.nulls(len(own.languages), pa.string()), pa.array(all_words)], ["lang", "phrase", "f"])

    found = texts.mapInArrow(run, "lang string, phrase string, f bigint")
    if k > 1:  # few k-grams of a batch recur in the next, so adding up before the shuffle would only fill memory
        found = found.repartition("lang", "phrase")
    counted = found.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return counted.where((F.col("f") >= least) | F.col("phrase").isNull())


def frequent_bits(grams: DataFrame, k: int) -> FrequentBits:
    """The bit table of a level's grams (lang, phrase), made by Spark in buckets of 4 KB."""
    n = grams.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_GRAM * n - 1).bit_length() if n else 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, _ = word_hashes([x.encode() for x in batch.column("phrase").to_pylist()])
            spoken = batch.column("lang").dictionary_encode()
            hashes = gram_hashes(_language_hash(spoken.dictionary.to_pylist())[spoken.indices.to_numpy()], words.reshape(-1, k))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(FrequentBits.places(hashes, bits)).astype("i8"))], ["bit"])

    places = grams.mapInArrow(run, "bit bigint")
    buckets = places.groupBy(F.expr(f"bit div {BUCKET}").alias("bucket")).agg(F.bitmap_construct_agg(F.col("bit") % BUCKET).alias("map")).collect()  # 8192 of 4 KB at most
    table = bytearray(bits // 8)
    for row in buckets:
        table[row["bucket"] * BUCKET // 8 : (row["bucket"] + 1) * BUCKET // 8] = row["map"]
    return FrequentBits(bits, bytes(table))


def level_tables(texts: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST_COUNT) -> list[DataFrame]:
    """The tables of levels 1 to ``most_words``, written one after the other."""
    out = [materialize(level(texts, 1, least), "words")]
    for k in range(2, most_words + 1):
        before = out[-1].where("phrase IS NOT NULL")
        out.append(materialize(level(texts, k, least, frequent_bits(before.select("lang", "phrase"), k - 1)), f"grams{k}", large=True))
    return out


def _joined(words: str, start: str, length: str) -> Column:
    return F.expr(f"array_join(slice({words}, {start}, {length}), ' ')")


def scored(tables: list[DataFrame], cover: int = COVER) -> DataFrame:
    """lang, phrase, a, l, r, score of every candidate that no longer candidate covers, by its lowest-scoring cut."""
    grams = tables[0].where("phrase IS NOT NULL")
    for table in tables[1:]:
        grams = grams.unionByName(table)
    candidates = grams.where("phrase LIKE '% %'").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    inner = candidates.where("size(w) > 2").select("lang", "a", "w", F.explode(F.expr("sequence(2, size(w) - 1)")).alias("n"))
    inner = inner.select("lang", "a", F.explode(F.expr("transform(sequence(1, size(w) - n + 1), i -> array_join(slice(w, i, n), ' '))")).alias("phrase"))
    covering = inner.groupBy("lang", "phrase").agg(F.max("a").alias("within"))
    kept = candidates.join(covering, ["lang", "phrase"], "left").where(f"within IS NULL OR 100 * CAST(within AS DECIMAL(30)) < {int(cover)} * CAST(a AS DECIMAL(30))")
    cuts = kept.select("lang", "phrase", "a", "w", F.explode(F.expr("sequence(1, size(w) - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _joined("w", "1", "k").alias("first"), _joined("w", "k + 1", "size(w) - k").alias("rest"))
    for part, count in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(grams.select("lang", F.col("phrase").alias(part), F.col("f").alias(count)), ["lang", part])
    score = F.expr("(CAST(1000000 AS DECIMAL(7)) * CAST(a AS DECIMAL(19)) * CAST(a AS DECIMAL(19))) div (CAST(l AS DECIMAL(19)) * CAST(r AS DECIMAL(19)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def first_of_each(rows: DataFrame, group: str, order: list[Column], top: int) -> DataFrame:
    """The first ``top`` rows of each group with their rank: the rows sorted into ranges, of which the leading ones are ranked."""
    ranged = materialize(rows.repartitionByRange(F.asc(group), *order).withColumn("range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy(group, "range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    leading = sizes.withColumn("before", before).where(F.col("before") < top).drop("n")
    ranked = ranged.join(leading, [group, "range"]).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy(group, "range").orderBy(*order)))
    return ranked.where(F.col("rank") <= top).drop("range", "before")


def collocations(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST_COUNT, top: int = TOP, cover: int = COVER, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of 2 to ``most_words`` words."""
    texts = docs.select(F.coalesce(quoted(lang_col).cast("string"), F.lit("und")).alias("lang"), whole_text(text_col).alias("text"))
    tables = level_tables(texts, most_words, least)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    words = tables[0].where("phrase IS NULL").select("lang", F.col("f").alias("n"))
    found = first_of_each(scored(tables, cover), "lang", order, top).join(words, "lang")
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
