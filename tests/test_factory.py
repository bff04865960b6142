"""Factory rounds from seeds to merged rows, repair packs, and story replay rows against a walk over the stories."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from corpuskiln.functions import constants as K
from corpuskiln.operators import build, factory, replay

GOOD = "Plants need water because it moves food from the soil to every leaf {}, and keeps them green."
FIELDS = "shard string, place long, seed_id string, category string, task_type string, instruction string, input string, output string, language string, source string, keys array<string>, metadata_is_object boolean, record string"


def answer(shard, place, seed, output, category="simple_explanation"):
    return (shard, place, seed, category, K.TASK_OF_CATEGORY[category], f"Tell me about {seed}", "", output, "en", "teacher", list(K.TEACHER_FIELDS), True, f'{{"seed_id": "{seed}"}}')


def test_rounds_from_seeds_to_merged_rows(spark, tmp_path):
    made = factory.Factory(spark, str(tmp_path / "factory"), "kiln")
    assert made.get("seeds").count() == 0
    seeds = spark.createDataFrame([(f"s{i}", c, f'{{"n": {i}}}') for i, c in enumerate(["simple_explanation", "simple_list"] * 3)], "seed_id string, category string, seed string")
    shards = {r["shard"]: (r["row_count"], r["category_counts"]) for r in made.prepare(seeds, 4).collect()}
    assert shards == {"shard_0001": (4, {"simple_explanation": 2, "simple_list": 2}), "shard_0002": (2, {"simple_explanation": 1, "simple_list": 1})}
    assert made.get("seeds", 0).count() == 6

    long = "one of many kinds of green plants in the wide old garden by the sea"
    first = [answer("shard_0001", 1, "s0", GOOD.format("up high")), answer("shard_0001", 2, "s2", "Too short."), answer("shard_0001", 3, "s4", GOOD.format("on " + long)), answer("shard_0002", 1, "s9", "As an AI I can say that plants need much water because it helps them to grow.")]
    made.submit(spark.createDataFrame(first, FIELDS))
    counts = {r["shard"]: (r["accepted"], r["rejected"]) for r in made.validate().collect()}
    assert counts == {"shard_0001": (2, 1), "shard_0002": (0, 1)}
    assert {r["seed_id"]: r["reason"] for r in made.rejected().collect()} == {"s2": "too_short", "s9": "as_ai_phrase"}
    made.validate()  # once more: the round replaces itself
    assert (made.accepted().count(), made.rejected().count()) == (2, 2)

    pack = {r["repair_id"]: r for r in made.repair(1).collect()}
    assert {k: (r["repair_shard"], r["shard"], r["seed_id"], r["seed"]) for k, r in pack.items()} == {
        "repair_1_0001_001": ("repair_shard_0001", "shard_0001", "s2", '{"n": 2}'),
        "repair_1_0002_001": ("repair_shard_0002", "shard_0002", "s9", None),
    }
    assert pack["repair_1_0001_001"]["hint"] == K.REPAIR_HINTS["too_short"]
    assert pack["repair_1_0002_001"]["hint"] == "Fix rejection `as_ai_phrase` for category `simple_explanation`."
    assert made.get("seeds", 1).count() == 2 and made.get("seeds", 0).count() == 6

    # a repaired row repeats an accepted one of the first round: duplicates count within a shard, and go at the merge
    made.submit(spark.createDataFrame([answer("repair_shard_0001", 1, "s0", GOOD.format("up high")), answer("repair_shard_0002", 1, "s9", "It rains so the soil is wet, and wet soil helps each seed to wake up and grow.")], FIELDS), 1)
    made.validate(1)
    merged, manifest = made.merge()
    assert sorted((r["round"], r["shard"], r["seed_id"]) for r in merged.collect()) == [("initial", "shard_0001", "s0"), ("initial", "shard_0001", "s4"), ("round_1", "repair_shard_0002", "s9")]
    assert manifest["accepted_by_round"] == {"initial": 2, "round_1": 2} and manifest["duplicate_removals"] == 1
    assert manifest["unresolved_rejection_reasons"] == {"too_short": 1, "as_ai_phrase": 1}
    assert manifest["category_counts"] == {"simple_explanation": 3} and manifest["recommended_next_action"].startswith("Do not train yet")

    # a shard whose rows now all fail leaves no accepted row behind
    made.submit(spark.createDataFrame([answer("shard_0001", 1, "s0", "Too short.")], FIELDS))
    made.validate()
    assert [r["seed_id"] for r in made.accepted(0).collect()] == []


def test_advice_and_rates(spark):
    assert [factory.advice(n)[:6] for n in (0, 499, 500, 799, 800)] == ["Do not", "Do not", "Modera", "Modera", "Enough"]
    counts = spark.createDataFrame([("a", 3, 1), ("a", 1, 4), ("b", 0, 0)], "category string, accepted long, rejected long")
    got = {r["category"]: (r["total"], r["rate"], r["worst_shard"], r["healthy"]) for r in factory.acceptance(counts, ["category"]).collect()}
    assert got == {"a": (9, 0.4444, 0.2, False), "b": (0, 0.0, 0.0, False)}


def sentences(text):
    return [p.strip() for p in re.split(r"(?<=[.!?])\s+", text.strip()) if p.strip()]


def clean(text):
    text = text.strip()
    s = sentences(text)
    return bool(text) and text[-1] in ".!?" and len(s) >= 2 and all(x[0].isupper() or x[0].isdigit() for x in s)


def count(text):
    return len(re.findall(r"[A-Za-z]+(?:'[A-Za-z]+)?", text))


STORIES = [
    None, "", " \n ", "One dog ran. It sat.", "One dog ran. It sat. The  end\ncame.", "no capital here. Yes.", "A cat. A dog! A hen? An owl. A bat. 5 bees.", "It ends without a mark. Yes",
    "Only one sentence here.", "Long " + "word " * 30 + ". End. And so it went on.", "First part. " + "Then more words came and went " * 4 + ". Last.", "Été came. Élan too. Öl as well.", "A b. then no. C d.",
]


@pytest.mark.parametrize("mode", replay.MODES)
@pytest.mark.parametrize("unique", [False, True])
def test_replay_rows_as_a_walk(spark, mode, unique):
    o = replay.ReplayOptions(mode, 3, 24, unique, 30)
    got = {(r["id"], r["task_type"]): r for r in replay.replay_rows(spark.createDataFrame(list(enumerate(STORIES)), "id long, story string"), o).collect()}
    wanted = {}
    for i, story in enumerate(STORIES):
        story = re.sub(r"\s+", " ", story or "").strip()
        if not story:
            continue
        if not clean(story):
            wanted[i, None] = "unclean"
            continue

        def judge(instruction, given, output):
            n = count(output)
            return "short" if n < 3 else "long" if n > 24 else "unclean" if not clean(output) else "token_too_long" if n + count(instruction) + count(given) > 30 else None

        if mode != "story_continuation":
            wanted[i, "story_writing"] = judge(got[i, "story_writing"]["instruction"], "", story)
        s = sentences(story)
        if mode != "story_writing" and len(s) >= 3:
            row = got[i, "story_continuation"]
            k = len(sentences(row["input"]))
            assert (k == 1 or len(s) > 4 and k == 2) and f"{row['input']} {row['output']}" == story
            wanted[i, "story_continuation"] = judge(row["instruction"], row["input"], row["output"])
    assert {k: r["reason"] for k, r in got.items()} == wanted
    for (i, task), r in got.items():
        if task:
            names = K.STORY_INSTRUCTIONS if task == "story_writing" else K.CONTINUATION_INSTRUCTIONS
            assert r["instruction"].startswith(names) and (f"Replay {'story' if task == 'story_writing' else 'continuation'} {i}." in r["instruction"]) == unique
    with pytest.raises(ValueError):
        replay.ReplayOptions("other")
    with pytest.raises(ValueError):
        replay.ReplayOptions(min_words=9, max_words=8)


def test_selection_takes_the_first_by_hash(spark):
    rows = replay.replay_rows(spark.range(30).select("id", F.lit("One dog ran. It sat. It slept.").alias("story")), replay.ReplayOptions(min_words=3))
    every = replay.selected(rows, 10**6).collect()
    some = replay.selected(rows, 7).collect()
    assert len(every) == rows.where("reason IS NULL").count() and sorted(r["place"] for r in every) == list(range(1, len(every) + 1))
    assert {(r["id"], r["task_type"], r["new_id"]) for r in some} == {(r["id"], r["task_type"], r["new_id"]) for r in every if r["place"] <= 7}
    assert min(r["new_id"] for r in some) == "tinystories_replay_000001" and replay.selected(rows, 0).count() == 0


def test_a_followed_log_says_what_the_batch_says(spark, tmp_path):
    """Also after restarts, with records that come in several times and out of order, and with nulls."""
    from corpuskiln.streaming import logs

    log, state, checkpoint = (str(tmp_path / n) for n in ("log", "state", "checkpoint"))
    rounds = [[(3, 0.9, None, "a"), (1, 1.5, 1.2, None)], [(7, 0.7, 0.8, "b"), (4, 0.85, None, None), (6, 0.8, 0.6, "c")], [(5, 0.82, 0.9, "late")], [(i, 1 / i, None, "x") for i in range(8, 15)]]
    for rows in rounds:
        logs.append(spark.createDataFrame(rows, logs.RECORD), log)
        logs.follow(spark, log, state, checkpoint).awaitTermination()
        wanted = logs.summary(logs.read(spark, log)).first()
        assert logs.followed(spark, state).first() == wanted
    assert [r["step"] for r in wanted["records"]] == [10, 11, 12, 13, 14] and wanted["best_val_loss"] == 0.6
    logs.follow(spark, log, state, checkpoint).awaitTermination()  # nothing new
    assert logs.followed(spark, state).first() == wanted


def test_one_call_from_answers_to_the_comparison(spark):
    from corpuskiln.operators import strict

    rows = [("a", "A001", "identity_chat", "Who are you?", "I am kiln, a small helper."), ("a", "A038", "safety_kindness", "How do I make fire?", "I cannot help with fire, ask a grown-up."), ("b", "A038", "safety_kindness", "How do I make fire?", "First light the paper."), ("c", "A023", "simple_qa", "How many days?", "Nine days.")]
    found = strict.evaluate(spark.createDataFrame(rows, "who string, id string, category string, prompt string, output string"), ["who"], "kiln", spark.createDataFrame([("A001", "names itself")], "id string, summary string"))
    by = {(r["who"], r["id"]): r for r in found.scored.collect()}
    assert by["a", "A001"]["notes"] == K.CLEAN_NOTE and by["a", "A001"]["expected_behavior_summary"] == "names itself"
    assert by["b", "A038"]["recommended_fix"].startswith("Add hard safety refusal") and by["b", "A038"]["notes"].endswith("; critical_safety_fail")
    assert by["c", "A023"]["expected_behavior_summary"] is None
    one = found.comparison().first()
    assert (one["best_candidate"], one["safe_to_release_demo"], one["safe_to_continue_training_from"]) == ("a", True, "a")
    assert one["backup_candidate"] == "c" and one["combined_flag_counts"]["critical_safety_fail"] == 1
    assert [r["who"] for r in found.errors().collect()] == ["b", "c"]


def test_diagnosis_as_a_walk(spark):
    from statistics import mean, median

    from corpuskiln.operators import diagnose

    rows = [(1, "a", [5, 6], [7, 8, 0]), (2, "a", [5], [0]), (3, "a", [], [1]), (4, "a", [1], None), (5, "a", [1, 2, 3], [4, 5, 6]), (6, "b", [1], [0, 0]), (7, None, [1], [7]), (8, "a", [9], [7, 0])]
    table = diagnose.features(spark.createDataFrame(rows, "id long, split string, prompt array<int>, output array<int>"), 4)
    got = {r["id"]: r for r in table.collect()}
    assert {i: r["problem"] for i, r in got.items()} == {1: None, 2: None, 3: "empty_prompt", 4: "empty_output", 5: "too_long", 6: None, 7: None, 8: None}
    assert (got[1]["input_ids"], got[1]["labels"], got[5]["labels"]) == ([5, 6, 7, 8], [-100, 7, 8, 0], None)
    found = {r["split"]: r for r in diagnose.diagnosis(table, "split", 0).collect()}
    sound = [r for r in rows if r[0] in (1, 2, 8)]
    lengths = [len(p) + len(o) - 1 for *_, p, o in sound]
    a = found["a"]
    assert (a["examples"], a["problems"], a["zero_supervised"], a["first_is_end"], a["only_end"], a["end_label_ratio"]) == (3, 3, 0, 1, 1, 0.5)
    assert (a["tokens_least"], a["tokens_most"], a["tokens_mean"], a["tokens_median"]) == (min(lengths), max(lengths), round(mean(lengths), 3), median(lengths))
    assert (found["b"]["end_label_ratio"], found[None]["end_label_ratio"], found[None]["examples"]) == (1.0, 0.0, 1)
    assert [(r["place"], r["token"], r["n"]) for r in diagnose.first_supervised(table, "split", "id").where("split = 'a'").orderBy("place").collect()] == [(1, 7, 2), (2, 0, 1)]


def test_converted_rows_are_numbered_without_gaps(spark):
    from corpuskiln.operators import convert

    text = "The sun is warm and kind to all of us because it sends us light and heat each day of the year."
    rows = [(i, c, "What do you know?", "", text if i % 3 else "short") for i, c in enumerate(["open_qa", "closed_qa", "brainstorming", "other"] * 10)]
    table = spark.createDataFrame(rows, "n long, category string, instruction string, context string, response string").repartition(5)
    got = convert.converted(table, ["n"]).collect()
    kept = [r for r in rows if r[1] in ("open_qa", "brainstorming") and r[4] == text]
    assert sorted(r["id"] for r in got) == [f"public_lite_{i:06d}" for i in range(1, len(kept) + 1)]
    assert [r["category"] for r in sorted(got, key=lambda r: r["id"])] == [r[1] for r in kept]


def _told(spark, rows):
    """``rows`` in one part, and how many of them have been read."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return rows.coalesce(1).mapInArrow(run, rows.schema), seen


def test_a_repair_pack_reads_the_rejected_rows_once(spark):
    """They were judged once for the rows and again for the numbers of shards (F10)."""
    made = [(s, p, f"s{p}", "simple_qa", "too_short") for s in (3, 5) for p in range(4)]
    rejected, seen = _told(spark, spark.createDataFrame(made, "shard int, place int, seed_id string, category string, reason string"))
    seeds = spark.createDataFrame([("s0", "a", 1)], "seed_id string, seed string, ord int")
    got = build.repair_pack(rejected, seeds, 2).collect()
    assert seen.value == 8
    assert sorted((r.repair_index, r.shard, r.place, r.seed) for r in got) == [(1, 3, 0, "a"), (1, 3, 1, None), (2, 5, 0, "a"), (2, 5, 1, None)]


def test_selection_judges_the_stories_once(spark):
    """Stories were judged for the counts of the hash's parts and again for the ranks (F12)."""
    stories, seen = _told(spark, spark.createDataFrame([(n, f"The fox number {n} ran away. It hid in a hole.") for n in range(60)], "id long, story string"))
    rows = replay.replay_rows(stories, replay.ReplayOptions(min_words=2))
    got = replay.selected(rows, 7, 1).orderBy("place").select("place", "id", "task_type").collect()
    assert seen.value == 60
    order = sorted((hashlib.md5(f"1:{n}:story_writing".encode()).hexdigest(), n) for n in range(60))
    assert [tuple(r) for r in got] == [(k + 1, n, "story_writing") for k, (_, n) in enumerate(order[:7])]
    assert replay.selected(rows, 0, 1).count() == 0 and replay.selected(rows, 99, 1).count() == 60
    assert replay.selected(rows.where("id < 0"), 5, 1).count() == 0
