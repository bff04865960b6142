"""Audit operators against walks over all pairs, and the branches of the conclusion."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from corpuskiln.functions import text as T
from corpuskiln.operators import audit
from corpuskiln.plans import audit as plans

RNG = random.Random(3)


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def varied(words, n):
    """Texts of which many are alike: copies, one word more or less, and others."""
    base = [[RNG.choice(words) for _ in range(25)] for _ in range(4)]
    out = []
    for _ in range(n):
        x = list(RNG.choice(base))
        for _ in range(RNG.randint(0, 3)):
            x[RNG.randrange(len(x))] = RNG.choice(words)
        out.append(" ".join(x))
    return [*out, "", "a b", "a b", out[0], out[0]]


WORDS = ["".join(RNG.choice("abcdef") for _ in range(RNG.randint(2, 6))) for _ in range(80)]
TEXTS = varied(WORDS, 40)


def test_near_clusters_are_those_of_a_walk(spark):
    sets = {i: set(x.split()) for i, x in enumerate(TEXTS)}
    want, clusters, seen = [], 0, []
    for i, own in sets.items():
        if len(own) < 4:
            continue
        hits = [(i, j, round(like(own, sets[j]), 6)) for j in seen if like(own, sets[j]) >= 0.86][:5]
        seen.append(i)
        if hits and clusters < 7:
            clusters += 1
            want += hits
    rows = spark.createDataFrame([(i, sorted(x)) for i, x in sets.items()], "id long, grams array<string>")
    got = audit.near_clusters(rows, clusters=7).withColumn("jaccard", F.round("jaccard", 6)).collect()
    assert want and sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("query", ["near_word_pair_counts", "near_char_pair_counts"])
def test_pair_counts_are_those_of_all_pairs(spark, tmp_path, query):
    rows = [(i, x, "xy"[i % 2]) for i, x in enumerate(TEXTS)] + [(900, None, "x"), (901, "alone here", "z")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    chars = lambda k: {k[i : i + 5] for i in range(len(k) - 4)} if len(k) > 5 else {k} - {""}
    sets = [(lang, chars(x or "") if "char" in query else set((x or "").split())) for _, x, lang in rows]
    want = dict.fromkeys("xyz", 0)
    for (one, a), (two, b) in itertools.combinations(sets, 2):
        want[one] += one == two and like(a, b) >= 0.82
    assert want["x"] > 3
    assert {r.lang: r.pairs for r in getattr(plans, query)(spark, str(tmp_path)).collect()} == want


def test_shingles_go_by_character(spark):
    text = "ab\U0001f600cd\U0001f600 ef"
    got = spark.range(1).select(T.shingles(F.lit(text)).alias("s")).first().s
    assert got == [text[i : i + 5] for i in range(len(text) - 4)]
    assert [spark.range(1).select(T.shingles(F.lit(x)).alias("s")).first().s for x in ("", "abc", "abcde", "abcdef")] == [[], ["abc"], ["abcde"], ["abcde", "bcdef"]]


def test_conclusion(spark):
    rows = [(10, 0, 9, 99), (10, 6, 1, 0), (10, 6, 2, 0), (10, 4, 3, 0), (10, 4, 0, 11), (0, 1, 0, 0), (10, 5, 0, 0)]
    got = spark.createDataFrame(rows, "n long, r long, p long, o long").select(audit.conclusion(*map(F.col, "nrpo"))).collect()
    mixed, harsh, bad = "Mixed evidence", "Evidence suggests build filter is over-aggressive", "Evidence suggests data is bad"
    assert [r[0] for r in got] == [mixed, harsh, mixed, bad, bad, harsh, mixed]


def test_log_summary(spark):
    log = spark.createDataFrame([(3, 0.5, None), (1, 2.0, 1.5), (2, 1.0, 1.25)], "step long, train double, val double")
    assert tuple(audit.log_summary(log, "step", "train", "val", 2).select("final_train_loss", "best_val_loss", "tail").first()) == (0.5, 1.25, [2, 3])
    empty = audit.log_summary(log.where("false"), "step", "train", "val").first()
    assert (empty.final_train_loss, empty.best_val_loss, empty.tail) == (None, None, [])
