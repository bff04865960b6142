import json
import random

import pytest
from pyspark.sql import functions as F

from corpuskiln.functions import text as T
from corpuskiln.operators import dedup, evaluation, profile, rules, sampling, tokens
from corpuskiln.sources import jsonl


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("make", "wanted"),
    [
        (lambda: T.words(F.lit("Don't STOP now")), ["don't", "stop", "now"]),
        (lambda: T.normalize_key(F.lit("  A\n b ")), "a b"),
        (lambda: T.repeated_sentence(F.lit("Go. Stop! go.")), True),
        (lambda: T.is_list(F.lit("- a\n- b")), True),
        (lambda: T.is_list(F.lit("a; b")), True),
        (lambda: T.is_list(F.lit("a, b")), False),
        (lambda: T.list_items(F.lit("a, b, c")), 3),
        (lambda: T.trailing_number(F.lit("x_0042")), 42),
        (lambda: T.trailing_number(F.lit("x")), 10**12),
        (lambda: T.obvious_loop(T.words(F.lit("go on " * 6))), True),
        (lambda: T.jaccard(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b"))), 0.5),
        (lambda: T.weird_nonword(F.lit("baaad strngthx")), True),
        (lambda: T.is_clean_story_span(F.lit("One fox ran. It hid.")), True),
    ],
)
def test_text(spark, make, wanted):
    assert value(spark, make()) == wanted


def test_scores(spark):
    rows = spark.createDataFrame([(1, None), (2, {"a": 4.0, "safety": 5.0}), (3, {"safety": 4.0, "a": 5.0}), (4, {}), (5, {"a": 3.0})], "id int, s map<string,double>")
    assert {r.id: r.p for r in rows.select("id", rules.score_pass(F.col("s")).alias("p")).collect()} == {1: True, 2: True, 3: False, 4: False, 5: False}


def test_greedy_is_the_sequential_rule(spark):
    rng = random.Random(3)
    n = 40
    edges = [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.08]
    blocked = {i for i in range(n) if rng.random() < 0.2}
    accepted, wanted = set(), {}
    for i in range(n):
        if any(a in accepted for a, b in edges if b == i):
            wanted[i] = "duplicate"
        elif i in blocked:
            wanted[i] = "blocked"
        else:
            wanted[i] = "accepted"
            accepted.add(i)
    rows = spark.createDataFrame([(i, i in blocked) for i in range(n)], "id long, blocked boolean")
    got = dedup.greedy_first(rows, spark.createDataFrame(edges, "earlier long, later long"))
    assert {r.id: r.state for r in got.collect()} == wanted


def test_split_and_shards(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2] if i else "c") for i in range(41)], "id long, g string")
    split = sampling.stratified_split(df, "g", "id", 0.25, 1)
    assert {(r.g, r.n) for r in split.where("split = 'val'").groupBy("g").agg(F.count("*").alias("n")).collect()} == {("a", 5), ("b", 5)}
    shards = sampling.interleaved_shards(df, "g", "id", 10, 1).collect()
    assert sorted(r.position for r in shards) == list(range(41))
    assert [r.g for r in sorted(shards, key=lambda r: r.position)][:5] == ["a", "b", "c", "a", "b"]


def test_numbers(spark):
    got = profile.numbers(spark.createDataFrame([(x,) for x in (1, 2, 3, 10)], "v int"), F.col("v"), []).first()
    assert (got.n, got.least, got.most, got.mean, got["median"], got.p90) == (4, 1, 10, 4.0, 2.5, 3.0)


def test_jsonl(spark, tmp_path):
    row = {"id": "1", "source": "s", "task_type": "dialogue", "instruction": "Say a word now", "input": "", "output": "x", "language": "en", "metadata": {}}
    (tmp_path / "a.jsonl").write_text("﻿" + json.dumps(row) + "\n\n[1]\n{bad\n", encoding="utf-8")
    got = [(r.line, r.error) for r in jsonl.parse_objects(jsonl.read_lines(spark, str(tmp_path / "a.jsonl"))).orderBy("line").collect()]
    assert got == [(1, None), (3, "not_object"), (4, "invalid_json")]
    assert jsonl.SourceSpec.parse("s=C:/x.jsonl:cap=5:task=dialogue=2") == jsonl.SourceSpec("s", "C:/x.jsonl", 5, {"dialogue": 2})


def test_features(spark):
    p, o = F.array(*[F.lit(x).cast("long") for x in (1, 2, 3)]), F.array(*[F.lit(x).cast("long") for x in (7, 8)])
    assert value(spark, tokens.input_ids(p, o)) == [1, 2, 3, 7]
    assert value(spark, tokens.labels(p, o)) == [-100, -100, 7, 8]
    assert [(list(r.x), list(r.y)) for r in value(spark, tokens.blocks(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda x: x.cast("long")), 2))] == [([1, 2], [2, 3]), ([3, 4], [4, 5])]


def scored(spark, rows):
    df = spark.createDataFrame(rows, "who string, id string, category string, flags array<string>")
    df = df.withColumn("severity", evaluation.severity(F.col("flags"), F.array_contains("flags", "critical_safety_fail")))
    return df.withColumn("score", evaluation.score(F.col("severity")))


def test_evaluation(spark):
    clean = [("a", str(i), "simple_explanation", []) for i in range(10)]
    rows = scored(spark, [*clean, ("b", "1", "simple_qa", ["simple_qa_fail"]), ("b", "2", "simple_qa", ["as_ai_phrase"]), ("c", "1", "safety_kindness", ["critical_safety_fail"]), ("c", "2", "simple_list", ["other"])])
    assert [(r.severity, r.score) for r in rows.where("who <> 'a'").orderBy("who", "id").collect()] == [("major", 0), ("minor", 1), ("critical", -1), ("ok", 2)]
    found = evaluation.decision(rows, ["who"])
    assert {r.who: r.decision for r in found.collect()} == {"a": "PASS_DEMO", "b": "NEEDS_TARGETED_CORRECTION", "c": "NO_GO"}
    ranked = evaluation.rank_candidates(found, "who").orderBy("rank").collect()
    assert [(r.who, r.trainable, r.continue_from) for r in ranked] == [("a", True, True), ("b", True, False), ("c", False, False)]
    assert [(r.who, r.id) for r in evaluation.errors(rows).collect()] == [("c", "1"), ("b", "1")]
    assert {(r.bucket, r.n, tuple(r.ids)) for r in evaluation.data_needs(rows, "id").collect()} == {("simple_qa_hard", 1, ("1",)), ("safety_refusal_hard", 1, ("1",))}
    empty = evaluation.decision(rows.limit(0), []).first()
    assert (empty.total, empty.total_score, empty.average_score, empty.decision) == (0, 0, 0.0, "PASS_DEMO")


def test_heuristic_rates(spark):
    names = ("story_collapse_non_story", "loop_detected", "list_format_fail", "identity_fail", "too_long_non_story", "as_ai_phrase", "safety_risk")
    rows = [("simple_list", {"loop_detected", "list_format_fail"}), ("simple_list", set()), ("identity_chat", {"identity_fail"}), ("story_request", {"loop_detected"})]
    df = spark.createDataFrame([(c, tuple(n in held for n in names)) for c, held in rows], "category string, heuristics struct<" + ", ".join(f"{n}: boolean" for n in names) + ">")
    r = evaluation.heuristic_rates(df, []).first()
    assert (r.total, r.loop_rate, r.list_format_fail_rate, r.identity_fail_rate, r.too_long_rate, r.as_ai_phrases) == (4, 0.5, 0.5, 1.0, 0.0, 0)
    assert evaluation.heuristic_rates(df.limit(0), []).first().loop_rate == 0.0
