"""Operator 10: I-Match document fingerprints, in DataFrame functions alone.

Terms are runs of letters or digits, lower case.  The lexicon is the band of terms that occur in at least
``1 / RARE`` and at most ``1 / COMMON`` of all documents (a band of inverse document frequency).  Its size is bounded
whatever the corpus: every document adds its distinct terms once, and a term needs 1 / RARE of the documents, so there
are at most RARE x (distinct terms a document) of them.  The lexicon is broadcast only after its size was counted;
above ``BROADCAST_TERMS`` it is joined by shuffle.  All of it falls at random into ``PARTS`` disjoint sub-lexicons, so
that every term of the band takes part: any change of a text's set of terms changes its fingerprint.  ``EXTRA`` smaller
sub-lexicons, of shares that halve from 1 / 64 to 1 / 8192, hold some of the terms once more; they leave hashes
unchanged when part of a long text, which fills every part, changes.  A document's fingerprint is, for each
sub-lexicon in which it has terms, the sub-lexicon's number and a hash of the set of these terms (the exclusive or of
the terms' 64-bit hashes, of which 32 bits stay).  Terms meet the lexicon by their 64-bit hashes.  Each text's terms
are found, met with the lexicon and folded in the task that holds the text: one row a term, then one a sub-lexicon,
then one a document.

Likeness of two fingerprints is the share of sub-lexicons with equal hashes among those in which either has a term;
if neither has any, 1 if the fingerprints (which then hold a hash of the text) are equal, else 0.

Defined results: null texts are empty; empty texts and texts without lexicon terms have a hash of their whole text for
a fingerprint, so that equal texts, and only they, are alike; very long texts are taken whole; rows repeat as they
are; the next document is the least of the texts under the next smaller id (ties: of equal ids the least text; null
ids come last, as one id); if all rows share one id, it is that id's least text; other columns, whatever their names,
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, whole_text

RARE, COMMON = 2000, 3
#: Disjoint sub-lexicons that the lexicon falls into, and smaller ones besides, EXTRA_A_SHARE of each share.
PARTS, EXTRA, EXTRA_A_SHARE = 8, 56, 7
BROADCAST_TERMS = 1_000_000
#: Fewer documents than this many make a term too rare, however small the table.
LEAST_DOCUMENTS = 2


def terms(text: Column) -> Column:
    """Distinct terms."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), "")


def term_hash(term: Column) -> Column:
    return F.xxhash64(term, F.lit(17))


def part(hashed: Column) -> Column:
    """Which of the PARTS a term falls into, from its hash."""
    return F.pmod(hashed, F.lit(PARTS)).cast("int")


def extra(hashed: Column) -> Column:
    """Which of the EXTRA sub-lexicons (from PARTS on) a term falls into as well, or -1.

    Other bits of the hash choose: 7 of 32 numbers one of the seven sub-lexicons of a share, the lowest bit set the share.
    """
    number = F.shiftrightunsigned(hashed, 8).bitwiseAND(31)
    bits = F.shiftrightunsigned(hashed, 13).bitwiseAND((1 << 20) - 1)
    share = F.bit_count(bits.bitwiseAND(-bits) - 1)
    return F.when((number < EXTRA_A_SHARE) & (share < EXTRA // EXTRA_A_SHARE), PARTS + share * EXTRA_A_SHARE + number).otherwise(-1).cast("int")


def lexicon(docs: DataFrame, rare: int = RARE, common: int = COMMON) -> DataFrame:
    """hash: the terms within the band of document frequency."""
    total = docs.count()
    counts = docs.select(F.explode(terms(whole_text())).alias("term")).select(term_hash(F.col("term")).alias("hash")).groupBy("hash").agg(F.count("*").alias("n"))
    band = counts.where((F.col("n") >= max(LEAST_DOCUMENTS, total / rare)) & (F.col("n") <= max(LEAST_DOCUMENTS, total / common)))
    return materialize(band.select("hash"), "lexicon")


def fingerprint_column(slots: Column, whole: Column) -> Column:
    """The fingerprint as text; ``whole`` is a hash of the text itself, which stands for one without lexicon terms."""
    shown = F.transform(slots, lambda x: F.lpad(F.lower(F.hex(x)), 10, "0"))
    return F.when(F.size(slots) > 0, F.array_join(shown, "-")).otherwise(whole)


def likeness(one: Column, two: Column, whole_one: Column, whole_two: Column) -> Column:
    places = lambda slots: F.transform(slots, lambda x: F.shiftright(x, 32))
    used = F.size(F.array_union(places(one), places(two)))
    return F.when(used > 0, F.size(F.array_intersect(one, two)) / used).otherwise((whole_one == whole_two).cast("double"))


def fingerprints(rows: DataFrame, words: DataFrame, columns: list[str], kept: list[str]) -> DataFrame:
    """``kept`` columns of ``rows``, of which ``key`` and ``number`` tell rows apart and ``key`` deals them out, with
    ``<name>_slots`` (sub-lexicon << 32 | hash, in order) and ``<name>_whole`` for each text column.

    A mark that the lexicon holds too keeps rows without lexicon terms.
    """
    spark = rows.sparkSession
    many = words.count() > BROADCAST_TERMS
    marked = words.unionByName(spark.range(1).select(term_hash(F.lit("")).alias("hash")))
    sides = [F.struct(F.lit(-1).alias("side"), F.array(F.lit("")).alias("terms"))]
    sides += [F.struct(F.lit(i).alias("side"), terms(F.col(c)).alias("terms")) for i, c in enumerate(columns)]
    keys = [*kept, *[f"{c}_whole" for c in columns]]
    whole = [F.substring(F.sha2(c, 256), 1, 16).alias(f"{c}_whole") for c in columns]
    found = rows.select(*kept, *whole, F.explode(F.array(*sides)).alias("x")).select(*keys, "x.side", F.explode("x.terms").alias("term"))
    found = found.select(*keys, "side", term_hash(F.col("term")).alias("hash")).join(marked if many else F.broadcast(marked), "hash", "left_semi")
    # a term is in one of the disjoint sub-lexicons, and may be in one of the others
    slots = F.explode(F.filter(F.array(part(F.col("hash")), extra(F.col("hash"))), lambda x: x >= 0)).alias("slot")
    folded = found.select(*keys, "side", "hash", slots).groupBy(*keys, "side", "slot").agg(F.bit_xor(F.xxhash64("hash")).alias("mixed"))
    packed = F.shiftleft(F.col("slot").cast("long"), 32).bitwiseOR(F.shiftrightunsigned("mixed", 32))
    sets = [F.sort_array(F.collect_list(F.when(F.col("side") == i, F.col("packed")))).alias(f"{c}_slots") for i, c in enumerate(columns)]
    return folded.select(*keys, "side", packed.alias("packed")).groupBy(*keys).agg(*sets)


def next_ids(docs: DataFrame) -> DataFrame:
    """doc_id, size (code points of its longest text), next_id: the next smaller id; the largest's for the smallest.

    Ids alone are sorted by range; only the first id of each range, one row a partition, meets in one task.
    """
    ids = docs.groupBy("doc_id").agg(F.max(F.length(whole_text())).alias("size"))
    ranged = materialize(ids.repartitionByRange(F.col("doc_id").desc_nulls_last()).withColumn("part", F.spark_partition_id()), "ids")
    within = Window.partitionBy("part").orderBy(F.col("doc_id").desc_nulls_last())
    led = ranged.select("part", "doc_id", "size", F.lead(F.struct("doc_id")).over(within).alias("next"))
    first = ranged.groupBy("part").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("first")).select("part", F.struct("first.doc_id").alias("first"))
    parts = Window.orderBy("part")
    first = first.select("part", F.lead("first").over(parts).alias("after"), F.first("first").over(parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("top"))
    return led.join(F.broadcast(first), "part").select("doc_id", "size", F.coalesce("next", "after", "top")["doc_id"].alias("next_id"))


def _key(doc_id: str) -> Column:
    """Equal for equal ids, null too, so that plain equality joins them."""
    return F.coalesce(F.col(doc_id).cast("string"), F.lit(""))


def with_edited(docs: DataFrame) -> DataFrame:
    """doc_id, key, number, next_key, text, edited: the last half of each text replaced by as much of the next document.

    Whole texts are dealt out once, by id; both sides of the join use that.  Of the next document only as much as its
    reader can take is sent on.
    """
    follow = materialize(next_ids(docs), "follow")
    dealt = docs.select("doc_id", _key("doc_id").alias("key"), whole_text().alias("text")).repartition("key")
    rows = dealt.withColumn("number", F.row_number().over(Window.partitionBy("key").orderBy("text")))
    after = follow.select(_key("next_id").alias("key"), _key("doc_id").alias("reader"), "size")
    # the least text of an id; written so that no limit moves below the shuffle, which then serves both sides
    heads = rows.where(F.col("number") * 2 == 2).join(after, "key")
    heads = heads.select(F.col("reader").alias("key"), _key("doc_id").alias("next_key"), F.substring("text", F.lit(1), F.floor(F.col("size") / 2).cast("int")).alias("head"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("head", F.lit(1), half))
    return rows.join(heads, "key").select("doc_id", "key", "number", "next_key", "text", edited.alias("edited"))


def fingerprint_digests(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document's."""
    words = lexicon(docs)
    rows = with_edited(docs).withColumns({"n_chars": F.length("text").cast("long"), "edited_sha256": F.sha2("edited", 256)})
    small = materialize(fingerprints(rows, words, ["text", "edited"], ["doc_id", "key", "number", "next_key", "n_chars", "edited_sha256"]), "fingerprints", large=True)
    following = small.where("number = 1").select(F.col("key").alias("next_key"), F.col("text_slots").alias("next_slots"), F.col("text_whole").alias("next_whole"))
    text, edited, after = ((F.col(f"{c}_slots"), F.col(f"{c}_whole")) for c in ("text", "edited", "next"))
    return small.join(following, "next_key").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        fingerprint_column(*text).alias("fingerprint"),
        fingerprint_column(*edited).alias("edited_fingerprint"),
        likeness(text[0], edited[0], text[1], edited[1]).alias("near_edited"),
        likeness(text[0], after[0], text[1], after[1]).alias("near_next"),
    )


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
