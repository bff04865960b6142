"""Factory rounds: seeds dealt into shards, answers validated shard by shard, rejected ones sent back, accepted ones merged.

All stages of a factory are one Parquet table, partitioned by stage, round and shard.  A stage's result replaces just the
partitions that it writes (dynamic partition overwrite), so a round that is run again replaces itself and nothing else.
Round 0 is the first; repair rounds count from 1.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..session import ensure_checkpoint_dir
from ..sources.lines import exists
from . import build, sampling, teacher

#: What a row of any stage may have; ``seed`` and ``record`` are JSON.
COLUMNS = (
    "place bigint, seed_id string, category string, task_type string, instruction string, input string, output string, language string, "
    "source string, keys array<string>, metadata_is_object boolean, reason string, warnings string, seed string, record string, hint string, repair_id string, from_shard string"
)
PARTITIONS = ("stage", "round", "shard")


def fix_hint(reason: Column, category: Column, name: str) -> Column:
    """What to do about a rejection."""
    known = F.create_map(*[F.lit(x.format(name=name)) for pair in K.REPAIR_HINTS.items() for x in pair])
    other = F.concat(F.lit("Fix rejection `"), F.coalesce(reason, F.lit("None")), F.lit("` for category `"), F.coalesce(category, F.lit("None")), F.lit("`."))
    return F.coalesce(F.element_at(known, reason), other)


def repair_rows(rejected: DataFrame, seeds: DataFrame, most: int, round: int, name: str) -> DataFrame:
    """A repair pack: the first ``most`` rejected rows (shard, place, seed_id, category, reason) of each shard, with seed, hint, repair_id and repair_shard.

    ``seeds`` has seed_id, seed and ord (the first of equal ids counts).  Repair shards are numbered without gaps in the
    order of shards, rows within them from 1.
    """
    pack = build.repair_pack(rejected, seeds, most)
    number = F.col("_n").cast("string")
    ranked = pack.withColumn("_n", F.row_number().over(Window.partitionBy("shard").orderBy("place")))
    padded = lambda c, n: F.when(F.length(c) >= n, c).otherwise(F.lpad(c, n, "0"))
    index = padded(F.col("repair_index").cast("string"), 4)
    repair_id = F.concat(F.lit(f"repair_{round}_"), index, F.lit("_"), padded(number, 3))
    return ranked.select(repair_id.alias("repair_id"), F.concat(F.lit("repair_shard_"), index).alias("repair_shard"), *pack.columns, fix_hint(F.col("reason"), F.col("category"), name).alias("hint"))


def unresolved(rejected: DataFrame) -> DataFrame:
    """reason, n of rejected rows."""
    return rejected.groupBy(F.coalesce("reason", F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n"))


def advice(merged: int) -> str:
    """What to do next with so many accepted rows (``build.merge_advice`` says it in a word)."""
    if merged >= 800:
        return "Enough accepted rows for mix/build."
    if merged >= 500:
        return "Moderate acceptance; consider one more repair round before training."
    return "Do not train yet (<500 accepted). Revise teacher prompts or run another repair round."


@dataclass(frozen=True)
class Factory:
    spark: SparkSession
    path: str
    name: str = "helper"
    strictness: str = "standard"

    def put(self, rows: DataFrame, stage: str, round: int) -> None:
        """``rows`` (shard and any of ``COLUMNS``) as a stage of a round; shards that they have replace earlier ones."""
        empty = self.spark.createDataFrame([], COLUMNS)
        have = set(rows.columns)
        full = rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema], F.lit(stage).alias("stage"), F.lit(round).cast("int").alias("round"), F.col("shard").cast("string").alias("shard"))
        full.repartition("shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(self.path)

    def get(self, stage: str, round: int | None = None) -> DataFrame:
        schema = self.spark.createDataFrame([], f"{COLUMNS}, stage string, round int, shard string").schema
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(self.path).where(F.col("stage") == stage)
        return rows if round is None else rows.where(F.col("round") == round)

    def prepare(self, seeds: DataFrame, shard_size: int = 100, seed: int = 1337) -> DataFrame:
        """Seeds (seed_id, category, seed) dealt into shards, categories in turn; shard, row_count and category_counts of each."""
        dealt = sampling.interleaved_shards(seeds.select("seed_id", "category", "seed"), "category", "seed_id", shard_size, seed)
        shard = F.concat(F.lit("shard_"), F.lpad((F.col("shard") + 1).cast("string"), 4, "0"))
        self.put(dealt.select("seed_id", "category", "seed", F.col("position").cast("long").alias("place"), shard.alias("shard")), "seeds", 0)
        return self.shards()

    def shards(self) -> DataFrame:
        counts = self.get("seeds", 0).groupBy("shard", "category").agg(F.count("*").alias("n"))
        listed = F.array_sort(F.collect_list(F.struct("category", "n")))
        return counts.groupBy("shard").agg(F.sum("n").alias("row_count"), F.map_from_entries(listed).alias("category_counts"))

    def submit(self, answers: DataFrame, round: int = 0) -> None:
        """Answers of a round: shard, place and a teacher row's columns, with ``record``, the row as JSON."""
        self.put(answers, "raw", round)

    def validate(self, round: int = 0) -> DataFrame:
        """Accept or reject each answer of a round, duplicates within a shard alone; shard, accepted, rejected of each."""
        raw = self.get("raw", round)
        ordered = sampling.hash_rank(raw.withColumn("_all", F.lit("")), "_all", F.concat_ws("\n", "shard", F.lpad(F.col("place").cast("string"), 19, "0")), "seed_id", "id").drop("_all")
        ensure_checkpoint_dir(self.spark)
        rows = ordered.withColumn("id", F.col("id").cast("long")).checkpoint()
        found = teacher.validate(rows, self.strictness, self.name, "shard").select("id", F.col("reason").alias("_reason"), F.array_join("warnings", ",").alias("_warnings"))
        judged = rows.join(found, "id").drop("id", "reason", "warnings").withColumnRenamed("_reason", "reason").withColumnRenamed("_warnings", "warnings").checkpoint()
        self.put(judged.drop("stage", "round"), "judged", round)
        return judged.groupBy("shard").agg(F.count_if(F.col("reason").isNull()).alias("accepted"), F.count_if(F.col("reason").isNotNull()).alias("rejected"))

    def accepted(self, round: int | None = None) -> DataFrame:
        return self.get("judged", round).where("reason IS NULL")

    def rejected(self, round: int | None = None) -> DataFrame:
        return self.get("judged", round).where("reason IS NOT NULL")

    def repair(self, round: int, most: int = 50) -> DataFrame:
        """The pack of repair round ``round``, of the first round's rejected rows; also stored, as the round's seeds."""
        seeds = self.get("seeds", 0).select("seed_id", "seed", F.col("place").alias("ord"))
        rejected = self.rejected(0).select("shard", "place", "seed_id", "category", "reason", "record")
        ensure_checkpoint_dir(self.spark)
        pack = repair_rows(rejected, seeds, most, round, self.name).checkpoint()
        self.put(pack.select("repair_id", "seed_id", "category", "reason", "seed", "record", "hint", "place", F.col("shard").alias("from_shard"), F.col("repair_shard").alias("shard")), "seeds", round)
        return pack

    def merge(self) -> tuple[DataFrame, dict]:
        """Accepted rows of all rounds without later copies (the first round first, then rounds by name), and what is known of them."""
        ensure_checkpoint_dir(self.spark)
        accepted = self.accepted().withColumn("round", F.when(F.col("round") == 0, "initial").otherwise(F.concat(F.lit("round_"), F.col("round").cast("string"))))
        merged = build.merge_accepted(accepted.withColumn("file", F.col("shard")).withColumn("line", F.col("place"))).drop("file", "line").checkpoint()
        counts = lambda df, c: {r[0]: r[1] for r in df.groupBy(F.coalesce(F.col(c), F.lit("unknown"))).count().collect()}
        total, all_rows = merged.count(), accepted.count()
        manifest = {
            "total_accepted": total,
            "duplicate_removals": all_rows - total,
            "accepted_by_round": counts(accepted, "round"),
            "category_counts": counts(merged, "category"),
            "task_type_counts": counts(merged, "task_type"),
            "source_counts": counts(merged, "source"),
            "unresolved_rejection_reasons": {r["reason"]: r["n"] for r in unresolved(self.rejected()).collect()},
            "recommended_next_action": advice(total),
        }
        return merged, manifest


def acceptance(counts: DataFrame, by: list[str]) -> DataFrame:
    """accepted, rejected, total, rate and health of rows (by, accepted, rejected), and worst_shard, the lowest rate of a row.

    Healthy is a rate of 0.5 or more.
    """
    total = F.sum("accepted") + F.sum("rejected")
    rate = F.coalesce(F.sum("accepted") / F.nullif(total, F.lit(0)), F.lit(0.0))
    own = F.coalesce(F.col("accepted") / F.nullif(F.col("accepted") + F.col("rejected"), F.lit(0)), F.lit(0.0))
    out = counts.withColumn("_own", own).groupBy(*by).agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"), total.alias("total"), F.round(rate, 4).alias("rate"), F.round(F.min("_own"), 4).alias("worst_shard"))
    return out.withColumn("healthy", F.col("rate") >= 0.5)
