"""Operator 7: near-duplicate detection by ProbMinHash.

A document is the multiset of its shingles of five words (lower case; ASCII punctuation and white space separate
words; a text of fewer words is one shingle), a shingle's weight being 1 + ln(count), so that a line repeated many
times doesn't drown the rest.  Each shingle sends a Poisson process of arrivals, with its weight as the rate, to the
registers of a signature; a register keeps its first arrival.  Arrivals are taken round by round, and a shingle stops
once its next arrival is later than all registers' (early termination).  Two signatures agree in a
register with the probability Jaccard similarity.  Registers are banded; documents that share a band are candidates.
A text that repeats shingles is signed once more with all weights 1, as a text without repeats is from the start: such
signatures agree with the plain Jaccard similarity, the measure that decides, however unequal the counts are.

Texts of the same words are one node from the start, so copies cost nothing later.  Within a band's bucket every node
is compared with the bucket's hub, the node that shares most bands with others (a star, linear in the bucket), and
linked if verified; then, where the nodes around a hub lie in several components still, those outside the largest are
compared with those nodes of other components that bounds on the similarity leave (``_meetings``), so no link between
candidates is lost, while pairs inside a component, which can't change the result, are never made.  Verification is
exact: Jaccard similarity of the sets of shingles of at least ``threshold``.  Classes are the connected components; a
class is named by its least doc_id.

Hubs may hold a large part of all nodes, so whatever is joined by hub is dealt out by (hub, salt).

Defined results: null and blank texts (white space only) are each a class of their own; texts without letters or
digits are alike only if equal; very long texts are compared whole; repeated rows are one class; null ids are members
like others but name a class only if no member has an id; ids of any size come back as they are; other columns,
whatever their names, are ignored by ``classes`` and kept by ``drop_near_duplicates``, which keeps the row of the least
doc_id of each class (ties: of equal ids that of the least text hash, of equal rows one); an empty table gives an empty
table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SetAside, derived, map_texts, materialize, release, sliced, texts_of, whole_text
from .components import connected_components
from .words import PUNCTUATION, mix, run_hashes, word_hashes

WORDS, THRESHOLD = 5, 0.8
#: 16 bands of 4: a pair of similarity 0.8 shares a band of its signatures of weight 1 with probability 0.9998.
BANDS, ROWS = 16, 4
CHARS = 1_000_000
#: Parts that the nodes of a hub are dealt out to.
SALTS = 32
#: Nodes that a part of a meeting holds on average; a meeting of fewer has one part.
PART_NODES = 64


def shingles(texts: list[str], k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, count) sorted by the first two, and a hash of each text's words (0: no words)."""
    words, firsts = word_hashes([t.lower().encode() for t in texts], PUNCTUATION)
    sizes = np.diff(firsts)
    doc = np.repeat(np.arange(len(texts)), sizes)
    grams = run_hashes(words, k)
    inside = np.flatnonzero(np.arange(len(grams)) + k <= firsts[1:][doc[: len(grams)]])
    owner, gram = doc[inside], grams[inside]
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    if len(short):
        owner = np.concatenate([owner, short])
        gram = np.concatenate([gram, [np.uint64(xxhash.xxh3_64_intdigest(words[firsts[i] : firsts[i + 1]].tobytes())) for i in short]])
    order = np.lexsort((gram, owner))
    owner, gram = owner[order], gram[order]
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(gram)), bool), (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])]))
    count = np.diff(np.concatenate([new, [len(gram)]]))
    same = np.array([xxhash.xxh3_64_intdigest(words[a:b].tobytes()) if b > a else 0 for a, b in zip(firsts[:-1], firsts[1:], strict=True)], "u8")
    return owner[new], gram[new], count, same


def prob_minhash(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures (n x m) of n weighted sets; a row without elements stays 0."""
    first = np.full(n * m, np.inf)
    kept = np.zeros(n * m, "u8")
    active, time, round_no = np.arange(len(element)), np.zeros(len(element)), 0
    while len(active):
        round_no += 1
        x = mix(element[active] + np.uint64(round_no * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((x >> np.uint64(11)).astype("f8") + 0.5) * 2.0**-53) / weight[active]
        slot = owner[active] * m + (mix(x ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(m)).astype("i8")
        hit = np.flatnonzero(time < first[slot])
        hit = hit[np.argsort(-time[hit], kind="stable")]  # of several arrivals at a register the earliest is written last
        first[slot[hit]] = time[hit]
        kept[slot[hit]] = element[active[hit]]
        on = time < first.reshape(n, m).max(axis=1)[owner[active]]
        active, time = active[on], time[on]
    return kept.reshape(n, m)


def bands(signatures: np.ndarray, b: int, r: int) -> np.ndarray:
    """n x b keys; equal keys mean equal registers in the same band."""
    key = np.broadcast_to(np.arange(1, b + 1, dtype="u8"), (len(signatures), b)).copy()
    parts = signatures[:, : b * r].reshape(-1, b, r)
    for i in range(r):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) ^ parts[:, :, i])
    return key


def band_keys(owner: np.ndarray, element: np.ndarray, count: np.ndarray, n: int, b: int = BANDS, r: int = ROWS) -> list[np.ndarray]:
    """Each text's band keys: of weights 1, and of weights 1 + ln(count) where that differs."""
    keys = list(bands(prob_minhash(owner, element, np.ones(len(element)), n, b * r), b, r).view("i8"))
    repeats = np.unique(owner[count > 1])
    chosen = np.isin(owner, repeats)
    weighted = bands(prob_minhash(np.searchsorted(repeats, owner[chosen]), element[chosen], 1 + np.log(count[chosen]), len(repeats), b * r), b, r).view("i8")
    for i, more in zip(repeats.tolist(), weighted, strict=True):
        keys[i] = np.union1d(keys[i], more)
    return keys


def signatures(docs: DataFrame, k: int = WORDS, b: int = BANDS, r: int = ROWS) -> DataFrame:
    """doc_id, text_hash, node (null if blank), keys (null if without shingles) of every row."""

    def run(texts: list[str]) -> dict[str, pa.Array]:
        owner, element, count, same = shingles(texts, k)
        keys = band_keys(owner, element, count, len(texts), b, r)
        nodes: list[int | None] = []
        for text, h in zip(texts, same.view("i8").tolist(), strict=True):
            nodes.append(h if h else xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63) if text.strip() else None)
        return {"node": pa.array(nodes, pa.int64()), "keys": pa.array([x if h else None for x, h in zip(keys, same, strict=True)], pa.list_(pa.int64()))}

    text = whole_text()
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return map_texts(rows, ["doc_id", "text_hash"], "node long, keys array<long>", lambda: run, CHARS)


def _compared(links: DataFrame, grams: DataFrame, rests: bool = False) -> DataFrame:
    """The links (a, b) with shared, size_a, size_b: how many shingles; with rests, rest: those of b that a hasn't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False)) for x, y in zip(batch.column("ga"), batch.column("gb"), strict=True)]
            common = [shared(x, y) for x, y in pairs]
            new = {"shared": [c.sum() for c in common], "size_a": [len(x) for x, _ in pairs], "size_b": [len(y) for _, y in pairs]}
            out = {name: pa.array(np.array(x, "i4"), pa.int32()) for name, x in new.items()}
            if rests:
                out["rest"] = pa.array([y[~c] for (_, y), c in zip(pairs, common, strict=True)], pa.list_(pa.int64()))
            yield derived(batch, ["a", "b"], out)

    one = grams.select(F.col("node").alias("a"), F.col("grams").alias("ga"))
    two = grams.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    kinds = "a long, b long, shared int, size_a int, size_b int" + ", rest array<long>" * rests
    return links.join(one, "a").join(two, "b").select("a", "b", "ga", "gb").mapInArrow(run, kinds)


def _similar(compared: DataFrame, threshold: float) -> DataFrame:
    """The links whose Jaccard similarity reaches the threshold."""
    return compared.where(F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared")) >= threshold).select("a", "b")


def shared(ga: np.ndarray, gb: np.ndarray) -> np.ndarray:
    """Which of the shingles gb are in ga; both are sorted and distinct."""
    if len(ga) == 0:
        return np.zeros(len(gb), bool)
    return ga[np.minimum(np.searchsorted(ga, gb), len(ga) - 1)] == gb


def _salted(rows: DataFrame) -> DataFrame:
    """``rows`` (hub, node, ...) with salt, which spreads a hub's nodes over tasks."""
    return rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))


def _parts(nodes: Column) -> Column:
    """In how many parts a meeting of so many nodes is joined."""
    return F.least(F.lit(SALTS), F.floor(nodes / PART_NODES) + 1).cast("int")


def _with_hubs(rows: DataFrame, hubs: DataFrame) -> DataFrame:
    """``rows`` (hub, salt, ...) joined with ``hubs`` (a row a hub), of which each salt gets a copy."""
    return rows.join(hubs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["hub", "salt"])


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` (hub, salt, node, ...) with the node's label, and the label that most nodes of the hub have (least one on ties)."""
    named = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    counted = named.select("hub", "node", "label").distinct().groupBy("hub", "label").agg(F.count("*").alias("n"))
    groups = counted.groupBy("hub").agg(F.count("*").alias("parts"), F.max_by("label", F.struct("n", -F.col("label"))).alias("largest")).where("parts > 1").drop("parts")
    return _with_hubs(named, groups)


def _meetings(stars: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """hub, gram, node, size, shared, left, parts: where nodes of different components around a hub may meet; none similar enough is lost.

    ``stars`` has hub (a), node (b), their sizes, how many shingles they share, and the node's rest.  Jaccard
    similarity t needs t / (1 + t) * (sum of sizes) shared shingles.  Two nodes share at most min(shared with the hub)
    of the hub's shingles; what is missing must be shared by their rests, so their rests meet in the rarest part of
    each, ordered by how many rests of the hub hold a shingle (prefix filter).  Rests of independent edits hardly meet.
    ``left`` counts the rest's shingles from this one on: two nodes that meet here first share no more of their rests.
    Where nothing can be missing, nodes meet in a null gram.  ``parts``, the same for all of a meeting, grows with the
    nodes that it may hold.
    """
    need = threshold / (1 + threshold)
    named = _labelled(_salted(stars.withColumnsRenamed({"a": "hub", "b": "node", "size_b": "size"})), labels)
    least = named.groupBy("hub").agg(F.min("size").alias("least"), F.count("*").alias("crowd"))
    mixed = _with_hubs(named, least).withColumn("missing", F.ceil(F.lit(need) * (F.col("size") + F.col("least")) - F.col("shared") - 1e-9))
    mixed = materialize(mixed.select("hub", "node", "size", "shared", "missing", "rest", "crowd"), "mixed")
    free = mixed.where("missing <= 0").select("hub", F.lit(None).cast("long").alias("gram"), "node", "size", "shared", F.lit(0).alias("left"), _parts(F.col("crowd")).alias("parts"))
    spread = mixed.where(F.size("rest") >= F.col("missing")).select("hub", "node", "size", "shared", (F.size("rest") - F.greatest("missing", F.lit(1)) + 1).alias("prefix"), F.explode("rest").alias("gram"))
    common = spread.groupBy("hub", "gram").agg(F.count("*").alias("n"))
    ordered = spread.join(common, ["hub", "gram"]).withColumn("place", F.row_number().over(Window.partitionBy("hub", "node").orderBy("n", "gram")))
    left = (F.col("size") - F.col("shared") - F.col("place") + 1).alias("left")
    met = ordered.where("n > 1 AND place <= prefix").select("hub", "gram", "node", "size", "shared", left, _parts(F.col("n")).alias("parts"))
    return materialize(free.unionByName(met), "meetings")


def _met(meetings: DataFrame, labels: DataFrame, threshold: float, star: bool) -> DataFrame:
    """Pairs (a, b) of different components that meet: with each meeting's least node, or all outside the hub's largest component with all others.

    Two nodes share at most the lesser number of the hub's shingles and, where they meet first in the order of the rests,
    the lesser number of what is left of their rests (positional filter: a pair that is similar enough passes at its
    first meeting at the latest).  In a null gram the former alone must do, as nodes that need a shared rest also meet
    in one of its shingles.

    A meeting's nodes are dealt out to its ``parts``, each of which gets a copy of what they are compared with: one for
    most meetings, so that copies don't outgrow the meetings.
    """
    named = _labelled(_salted(meetings), labels).withColumn("salt", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    taken = ("node", "label", "size", "shared", "left")
    if star:
        least = named.groupBy("hub", "gram").agg(F.min(F.struct(*taken)).alias("x"), F.max("parts").alias("parts"))
        one = least.select("hub", "gram", "parts", *[F.col(f"x.{c}").alias(f"{c}_a") for c in taken])
        other = F.lit(True)
    else:
        one = named.where("label <> largest").select("hub", "gram", "parts", *[F.col(c).alias(f"{c}_a") for c in taken])
        other = (F.col("label") == F.col("largest")) | (F.col("node_a") < F.col("node"))
    one = one.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    fits = F.least("size_a", "size") >= F.lit(threshold) * F.greatest("size_a", "size") - 1e-9
    most = F.least("shared_a", "shared") + F.when(one["gram"].isNull(), 0).otherwise(F.least("left_a", "left"))
    fits &= most >= F.lit(threshold / (1 + threshold)) * (F.col("size_a") + F.col("size")) - 1e-9
    same = (one["hub"] == named["hub"]) & (one["salt"] == named["salt"]) & one["gram"].eqNullSafe(named["gram"])
    joined = one.join(named, same & (F.col("label_a") != F.col("label")) & other & fits)
    return joined.select(F.least("node_a", "node").alias("a"), F.greatest("node_a", "node").alias("b")).distinct()


def _grams(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """node, grams of the documents that stand for the given nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", CHARS):
            owner, element, _, _ = shingles(texts_of(batch), k)
            cut = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            grams = [np.sort(element[a:b].view("i8")) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield derived(batch, ["node"], {"grams": pa.array(grams, pa.list_(pa.int64()))})

    text = whole_text()
    keyed = docs.select(F.col("doc_id").alias("rep_id"), F.xxhash64(text).alias("rep_hash"), text.alias("text"))
    found = nodes.join(keyed, nodes["rep_id"].eqNullSafe(keyed["rep_id"]) & (nodes["rep_hash"] == keyed["rep_hash"]))
    one = found.select("node", "text").withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("text"))).where("place = 1")
    return one.select("node", "text").mapInArrow(run, "node long, grams array<long>")


def classes(docs: DataFrame, k: int = WORDS, threshold: float = THRESHOLD, b: int = BANDS, r: int = ROWS) -> DataFrame:
    """doc_id, text_hash, class_id, keep (this row stands for its class) of every row; rows equal in id and text stand together."""
    rows = materialize(signatures(docs, k, b, r), "signatures")
    whole = rows.where("node IS NOT NULL")
    # a node's stand-in: the least (id, text hash) among its rows, ids that are null last
    nodes = whole.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("rep"))
    nodes = materialize(nodes.select("node", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash")), "nodes")
    members = materialize(whole.where("keys IS NOT NULL").select("node", F.explode("keys").alias("key")).groupBy("key", "node").agg(F.count("*").alias("n")).select("key", "node"), "members")
    # a bucket's hub is the node that shares the most bands with others: the nearest to a group's middle
    crowd = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    crowded = members.join(crowd, "key")
    liked = crowded.groupBy("node").agg((F.shiftleft(F.sum("n"), 20) + F.col("node").bitwiseAND(0xFFFFF)).alias("rank"))
    crowded = materialize(crowded.select("key", "node").join(liked, "node"), "crowded")
    hubs = crowded.groupBy("key").agg(F.max_by("node", "rank").alias("hub"))
    stars = crowded.join(hubs, "key").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    stars = materialize(stars, "stars")
    touched = stars.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    grams = materialize(_grams(docs, nodes.join(touched, "node"), k), "grams", large=True)
    compared = materialize(_compared(stars, grams, rests=True), "compared", large=True)
    linked = _similar(compared, threshold)
    labels = connected_components(linked)
    # links between nodes that share a bucket but not through its hub: by stars first, then all that is left
    meetings = _meetings(compared, labels, threshold)
    for star in (True, False):
        pairs = _met(meetings, labels, threshold, star)
        more = materialize(_similar(_compared(pairs, grams), threshold), "links")
        if more.limit(1).collect():
            linked = linked.union(more)
            labels = connected_components(linked)

    owned = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    best = owned.groupBy("label").agg(F.min(F.struct(F.col("rep_id").isNull().alias("none"), "rep_id", "rep_hash")).alias("best"))
    named = owned.join(best, "label").select("node", F.col("best.rep_id").alias("class_id"), F.col("best.rep_hash").alias("best_hash"))
    out = rows.drop("keys").join(named, "node", "left")
    keep = F.col("node").isNull() | (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_hash") == F.col("best_hash")))
    return out.select("doc_id", "text_hash", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), keep.alias("keep"), F.col("node").isNull().alias("blank"))


def drop_near_duplicates(docs: DataFrame, k: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class, blank texts all kept."""
    aside = SetAside.of(docs)
    keyed = aside.rows.select("*", aside.column("doc_id").alias("doc_id"))
    kept = classes(keyed.select("doc_id", "text"), k, threshold).where("keep AND NOT blank").select(F.col("doc_id").alias("kept_id"), "text_hash").distinct()
    release(docs.sparkSession)
    joined = keyed.withColumn("hash", F.xxhash64(whole_text())).join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("hash") == F.col("text_hash")))
    # of equal rows one stays; blank texts all do, and are not dealt out
    first = joined.withColumn("place", F.row_number().over(Window.partitionBy("kept_id", "text_hash").orderBy("kept_id"))).where("place = 1")
    return aside.back(first.select("row", "text").unionByName(aside.rows.where(~whole_text().rlike(r"(?U)[^\s\x1c-\x1f]"))))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "keep")
