"""Audit of a build: what a filter rejected of the rows that the factory had accepted, and whether data or filter is to blame.

Rows have row_id, source, task_type, category, instruction, input, output and ord (a number, the order); rejected rows
also bucket and reason.  Rows are compared by fingerprints of their normalised content.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from . import audit, profile, sampling

UNKNOWN = "UNKNOWN"


def fingerprint() -> Column:
    """128 bits of source, task type and normalised instruction, input and output."""
    parts = [F.coalesce("source", F.lit(UNKNOWN)), F.coalesce("task_type", F.lit(UNKNOWN)), *[T.normalize_key(F.coalesce(c, F.lit(""))) for c in ("instruction", "input", "output")]]
    return F.md5(F.concat_ws("\n", *parts).cast("binary"))


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row of the different keys of both sides: both, left_only, right_only, and whether each side's lie in the other's.

    Keys are marked by side and added up: no join, and a key that a third of all rows have is a row a task.  Null keys
    count as one key.
    """
    sides = left.select(F.col(key).alias("key"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(F.col(key).alias("key"), F.lit(0).alias("l"), F.lit(1).alias("r")))
    met = sides.groupBy("key").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    counts = met.agg(F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("both"), F.count_if(F.col("r") == 0).alias("left_only"), F.count_if(F.col("l") == 0).alias("right_only"))
    return counts.select("both", "left_only", "right_only", (F.col("left_only") == 0).alias("left_in_right"), (F.col("right_only") == 0).alias("right_in_left"))


def without(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` whose key ``right`` doesn't have; a null key is like any other."""
    gone = right.select(F.coalesce(F.col(key), F.lit("")).alias("_key"), F.col(key).isNull().alias("_null")).distinct()
    return left.join(gone, (F.coalesce(F.col(key), F.lit("")) == F.col("_key")) & (F.col(key).isNull() == F.col("_null")), "left_anti")


def duplicate_maps(rows: DataFrame) -> DataFrame:
    """map, display (as first seen), n of what occurs more than once by five keys, all in one pass; blank keys don't count."""
    text = lambda c: F.coalesce(c, F.lit(""))
    shown = lambda c: T.normalize_display(text(c))
    task = F.coalesce("task_type", F.lit(UNKNOWN))
    entry = lambda name, key, display: F.struct(F.lit(name).alias("map"), T.normalize_key(key).alias("key"), display.alias("display"))
    entries = F.array(
        entry("instruction_only", text("instruction"), shown("instruction")),
        entry("output_only", text("output"), shown("output")),
        entry("instruction_output_pair", F.concat(text("instruction"), F.lit("\n"), text("output")), F.concat(shown("instruction"), F.lit(" || "), shown("output"))),
        entry("output_within_task_type", F.concat(task, F.lit("\n"), text("output")), F.concat(task, F.lit(" :: "), shown("output"))),
        entry("output_across_all_tasks", text("output"), shown("output")),
    )
    spread = rows.select("ord", F.explode(entries).alias("x")).select("ord", "x.*").where("key <> ''")
    return spread.groupBy("map", F.sha2("key", 256).alias("key")).agg(F.min_by("display", "ord").alias("display"), F.count("*").alias("n")).where("n > 1").select("map", "display", "n")


def top_clusters(rows: DataFrame, most: int = 10, samples: int = 3) -> DataFrame:
    """place, display, n, task_types, categories (counts), first_ids: the largest groups of equal outputs."""
    keyed = rows.select("ord", "row_id", F.coalesce("task_type", F.lit(UNKNOWN)).alias("task_type"), F.coalesce("category", F.lit(UNKNOWN)).alias("category"), T.normalize_display(F.coalesce("output", F.lit(""))).alias("display"), F.sha2(T.normalize_key(F.coalesce("output", F.lit(""))), 256).alias("key")).where("display <> ''")
    top = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min_by("display", "ord").alias("display")).where("n > 1").orderBy(F.desc("n"), "display").limit(most)
    own = keyed.drop("display").join(F.broadcast(top), "key")  # ``most`` rows
    listed = lambda c: own.groupBy("key", c).agg(F.count("*").alias("m")).groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "m")))).alias(c))
    first = own.withColumn("i", F.row_number().over(Window.partitionBy("key").orderBy("ord"))).where(F.col("i") <= samples).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "row_id"))), lambda s: s["row_id"]).alias("first_ids"))
    found = top.join(listed("task_type"), "key").join(listed("category"), "key").join(first, "key")
    place = F.row_number().over(Window.orderBy(F.desc("n"), "display"))
    return found.select(place.alias("place"), "display", "n", F.col("task_type").alias("task_types"), F.col("category").alias("categories"), "first_ids")


def losses(accepted: DataFrame, rejected: DataFrame, targets: tuple[str, ...] = K.TARGET_CATEGORIES) -> DataFrame:
    """key, factory_accepted, build_rejected of the targets that any row has as its task type or category."""
    each = lambda df, side: df.select(F.explode(F.array_distinct(F.array("task_type", "category"))).alias("key"), F.lit(side).alias("side")).where(F.col("key").isin(*targets))
    both = each(accepted, 0).unionByName(each(rejected, 1))
    return both.groupBy("key").agg(F.count_if(F.col("side") == 0).alias("factory_accepted"), F.count_if(F.col("side") == 1).alias("build_rejected"))


def lengths(rows: DataFrame) -> DataFrame:
    """task_type, field, least, median (rounded down), p90 of the words of instructions and outputs."""
    counts = F.array(*[F.struct(F.lit(f).alias("field"), T.word_count(F.coalesce(c, F.lit(""))).alias("words")) for f, c in (("instruction_words", "instruction"), ("output_words", "output"))])
    spread = rows.select(F.coalesce("task_type", F.lit(UNKNOWN)).alias("task_type"), F.explode(counts).alias("x")).select("task_type", "x.*")
    return profile.numbers(spread, F.col("words"), ["task_type", "field"]).select("task_type", "field", "least", F.floor("median").alias("median"), F.col("p90").cast("long").alias("p90"))


@dataclass(frozen=True)
class BuildAudit:
    """The whole audit of one build; each part is a DataFrame of its own."""

    raw: DataFrame
    accepted: DataFrame
    rejected: DataFrame
    source: str
    samples: int = 10
    seed: int = 1337

    @cached_property
    def own_rejected(self) -> DataFrame:
        """Rejected rows of the audited source."""
        return self.rejected.where(F.col("source") == self.source)

    def counts(self) -> DataFrame:
        """part, dim, key, n: rows by source, task type and category of each part."""
        parts = (("raw", self.raw, ["source", "task_type"]), ("factory_accepted", self.accepted, ["source", "task_type", "category"]), ("rejected", self.rejected, ["bucket"]), ("own_rejected", self.own_rejected, ["task_type", "category"]))
        out = None
        for name, rows, dims in parts:
            one = profile.grouped_counts(rows.select(*[F.coalesce(d, F.lit(UNKNOWN)).alias(d) for d in dims]), dims).select(F.lit(name).alias("part"), "dim", "key", "n")
            out = one if out is None else out.unionByName(one)
        return out

    def overlap(self) -> DataFrame:
        """One row: fingerprints and ids that were accepted and rejected, different ids rejected, and whether all of them had been accepted."""
        printed = [df.withColumn("print", fingerprint()) for df in (self.accepted, self.own_rejected)]
        prints, ids = overlap(*printed, "print"), overlap(self.accepted, self.own_rejected, "row_id")
        rejected_ids = (F.col("i.both") + F.col("i.right_only")).alias("rejected_ids")
        return prints.alias("p").crossJoin(F.broadcast(ids.alias("i"))).select(F.col("p.both").alias("accepted_and_rejected"), F.col("i.both").alias("accepted_and_rejected_by_id"), rejected_ids, F.col("p.right_in_left").alias("all_rejected_were_accepted"))

    def duplicates(self) -> DataFrame:
        return duplicate_maps(self.accepted)

    def clusters(self) -> DataFrame:
        return top_clusters(self.accepted)

    def sampled(self) -> DataFrame:
        """reason, row_id, source, task_type, category, instruction, output: so many rejected rows of each reason, by hash."""
        named = self.own_rejected.withColumn("reason", F.coalesce("reason", "bucket"))
        return sampling.sample_per_group(named, "reason", "ord", self.samples, self.seed).select("reason", "row_id", "source", "task_type", "category", "instruction", "output")

    def kept_lengths(self) -> DataFrame:
        """Lengths of the source's raw rows whose content wasn't rejected."""
        raw = self.raw.where(F.col("source") == self.source).withColumn("print", fingerprint())
        return lengths(without(raw, self.own_rejected.withColumn("print", fingerprint()), "print"))

    def rejected_lengths(self) -> DataFrame:
        return lengths(self.own_rejected)

    def losses(self) -> DataFrame:
        return losses(self.accepted, self.own_rejected)

    def conclusion(self) -> DataFrame:
        """One row: accepted, rejected, pair_copies, output_copies and what they speak for."""
        rows, gone = self.accepted.agg(F.count("*").alias("accepted")), self.own_rejected.agg(F.count("*").alias("rejected"))
        sums = self.duplicates().agg(*[F.coalesce(F.sum(F.when(F.col("map") == m, F.col("n"))), F.lit(0)).alias(name) for m, name in (("instruction_output_pair", "pair_copies"), ("output_across_all_tasks", "output_copies"))])
        one = rows.crossJoin(F.broadcast(gone)).crossJoin(F.broadcast(sums))
        return one.select("accepted", "rejected", "pair_copies", "output_copies", audit.conclusion(*map(F.col, ("accepted", "rejected", "pair_copies", "output_copies"))).alias("conclusion"))
