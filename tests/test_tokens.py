"""Lines read in splits, segments, running sums, token sets, token files and embedding pairs, against walks and brute force."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskiln.operators import build, similar, stream, tokenset
from corpuskiln.sources import lines, tokenfiles

MARK = stream.MARK


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def write_files(folder):
    rng = random.Random(5)
    texts = {
        "a.txt": "﻿" + "".join(f"line {i} {'x' * rng.randrange(60)}{rng.choice(['\n', '\r\n', '\n\n'])}" for i in range(300)),
        "b.txt": "".join(f"é{i}\r" for i in range(400)) + "no line end",
        "c.txt": "",
        "d.txt": "\n\n  \n",
        "e.txt": "﻿",
        "f.txt": "one long line " * 500 + "\r\nthe next",
    }
    for name, text in texts.items():
        with open(os.path.join(folder, name), "w", encoding="utf-8", newline="") as f:
            f.write(text)


def walk(folder):
    out = []
    for name in sorted(os.listdir(folder)):
        with open(os.path.join(folder, name), encoding="utf-8-sig") as f:
            out += [(name, i, line.rstrip("\n")) for i, line in enumerate(f, 1)]
    return out


def test_lines_of_many_splits(spark, tmp_path, small_splits):
    write_files(tmp_path)
    wanted = walk(tmp_path)
    found = lines.read_lines(spark, str(tmp_path))
    assert found.select("block").distinct().count() > 10
    rows = found.orderBy("ordinal").collect()
    assert [r["ordinal"] for r in rows] == list(range(1, len(rows) + 1))
    got = [(r["file"], r["line"], r["value"]) for r in rows if r["file"] != "e.txt"]
    assert got == [w for w in wanted if w[0] != "e.txt"]
    assert all(r["value"] == "" for r in rows if r["file"] == "e.txt")  # a mark alone is an empty line at most
    for limit in (0, 1, 299, 600, 10**6):
        assert [r["ordinal"] for r in lines.read_lines(spark, str(tmp_path), limit=limit).orderBy("ordinal").collect()] == [r["ordinal"] for r in rows][:limit]
    assert lines.read_lines(spark, [str(tmp_path / "b.txt"), str(tmp_path / "a.txt")]).count() == sum(w[0] in ("a.txt", "b.txt") for w in wanted)


def test_missing_files(spark, tmp_path):
    assert lines.read_lines(spark, str(tmp_path / "none.txt"), missing_ok=True).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        lines.read_lines(spark, str(tmp_path / "none.txt")).count()


def segment_walk(rows):
    out, held = [], []

    def end():
        text = "\n".join(held).strip()
        held.clear()
        if text:
            out.append((text if MARK in text else f"{text}\n{MARK}") + "\n")

    for value in rows:
        if value.strip():
            held.append(value)
        if not value.strip() or MARK in value:
            end()
    end()
    return out or [MARK + "\n"]


def test_segments_as_a_walk_over_lines(spark):
    rng = random.Random(9)
    files = {f"f{n}": [rng.choice(["", "  ", " ", "one line", " two ", MARK, f"x {MARK} y", "three"]) for _ in range(n)] for n in (0, 1, 2, 7, 40, 200)}
    files |= {"blank": ["", " \t"], "marks": [MARK, MARK], "run on": ["a"] * 50}
    rows = [(f, i, i // 6, v) for f, values in files.items() for i, v in enumerate(values)]
    table = spark.createDataFrame(rows, "file string, line long, block long, value string").repartition(7)
    for block in (None, "block"):
        got = {}
        for r in stream.segments(table, block=block).orderBy("file", "segment").collect():
            got.setdefault(r["file"], []).append(r["text"])
        assert got == {f: segment_walk(values) for f, values in files.items() if values}


def test_segments_of_files_in_splits(spark, tmp_path, small_splits):
    write_files(tmp_path)
    found = stream.segments(lines.read_lines(spark, str(tmp_path)), block="block").orderBy("file", "segment").collect()
    by_file = {}
    for name, _, value in walk(tmp_path):
        by_file.setdefault(name, []).append(value)
    for name in ("a.txt", "b.txt", "d.txt", "f.txt"):
        assert [r["text"] for r in found if r["file"] == name] == segment_walk(by_file[name])


def test_running_sum(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), i, rng.choice([0, 1, 5, None])) for i in range(500)]
    got = stream.running_sum(spark.createDataFrame(rows, "k string, i long, n int").repartition(6), ["k", "i"], "n", "before").collect()
    total, wanted = 0, {}
    for k, i, n in sorted(rows, key=lambda r: r[:2]):
        wanted[k, i] = total
        total += n or 0
    assert {(r["k"], r["i"]): r["before"] for r in got} == wanted


def stream_of(segments, block, fraction):
    ids = [x for _, own in sorted(segments) for x in own]
    times = -(-(2 * (block + 2) + 1) // len(ids)) if len(ids) < 2 * (block + 2) + 1 else 1
    ids = ids * times
    val = build.tail_split(len(ids), block, fraction)
    return {"train": ids[:-val], "val": ids[-val:]}, times


def block_rows(token_set):
    return {(r["split"], r["block"]): (r["x"], r["y"]) for r in token_set.blocks().collect()}


def blocks_of(splits, block):
    return {(s, b): (ids[b * block : b * block + block], ids[b * block + 1 : b * block + block + 1]) for s, ids in splits.items() for b in range((len(ids) - 1) // block)}


@pytest.mark.parametrize("sizes, block, fraction", [([5, 0, 1, 300, 2, 2, 77], 8, 0.2), ([3], 4, 0.1), ([1000], 16, 0.5), ([1] * 90, 7, 0.3), ([40, 41], 64, 0.1)])
def test_blocks_across_segments(spark, sizes, block, fraction):
    rng = random.Random(sum(sizes))
    segments = [(i, [rng.randrange(500) for _ in range(n)]) for i, n in enumerate(sizes)]
    found = tokenset.prepare(spark.createDataFrame(segments, "i long, ids array<int>").repartition(3), ["i"], block, fraction, 500)
    splits, times = stream_of(segments, block, fraction)
    assert (found.metadata["train_token_count"], found.metadata["val_token_count"]) == (len(splits["train"]), len(splits["val"]))
    assert (found.metadata["train_repeat_factor"], found.metadata["validation_mode"]) == (times, "split")
    assert block_rows(found) == blocks_of(splits, block)


def test_separate_validation(spark):
    train, val = ([(i, [i, i + 1, i + 2]) for i in range(n)] for n in (40, 3))
    frames = [spark.createDataFrame(x, "i long, ids array<int>") for x in (train, val)]
    found = tokenset.prepare(frames[0], ["i"], 10, 0.1, 500, frames[1])
    wanted = {"train": [x for _, own in train for x in own], "val": [x for _, own in val for x in own] * 3}
    assert block_rows(found) == blocks_of(wanted, 10)
    assert found.metadata["val_repeat_factor"] == 3 and not found.metadata["val_fraction_used_for_split"]


def test_token_set_errors(spark):
    frame = spark.createDataFrame([(1, [1, 2, 3] * 50)], "i long, ids array<int>")
    with pytest.raises(Exception, match="token id 3 is not below"):
        tokenset.prepare(frame, ["i"], 8, 0.2, 3)
    with pytest.raises(ValueError, match="no tokens"):
        tokenset.prepare(frame.where("false"), ["i"], 8)
    for fraction, block in ((0.0, 8), (1.0, 8), (0.1, 0)):
        with pytest.raises(ValueError):
            tokenset.prepare(frame, ["i"], block, fraction)


def test_library_ids(spark, tmp_path):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = tokenset.TokenizerFile(path)
    texts = ["Some words, and more words.", None, "", "été <|endoftext|>", "x" * 300]
    got = tokenset.library_ids(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), path, at_once=2).orderBy("i").collect()
    assert [r["ids"] for r in got] == [tokenizer.encode(t or "") for t in texts]
    assert tokenizer.token_to_id("<|endoftext|>") in got[3]["ids"] and tokenizer.token_to_id("no such token") is None
    assert max(i for r in got for i in r["ids"]) < tokenizer.vocab_size
    tokenizer.save(str(tmp_path / "copy.json"))
    assert tokenset.TokenizerFile(str(tmp_path / "copy.json")).decode(got[0]["ids"]) == tokenizer.decode(got[0]["ids"])


def read_bytes(path):
    files = sorted(f for f in os.listdir(path) if f.endswith(".bin"))
    return [x for f in files for x in np.fromfile(os.path.join(path, f), "<u2").tolist()]


def test_token_files_come_back(spark, tmp_path):
    rng = random.Random(1)
    segments = [(i, [rng.randrange(60_000) for _ in range(rng.randrange(40))]) for i in range(300)]
    found = tokenset.prepare(spark.createDataFrame(segments, "i long, ids array<int>").repartition(5), ["i"], 16, 0.25)
    path = str(tmp_path / "set")
    known = tokenfiles.write_token_set(found, path, files=4)
    splits, _ = stream_of(segments, 16, 0.25)
    for split, ids in splits.items():
        assert read_bytes(f"{path}/{split}") == ids
        back = tokenfiles.read_tokens(spark, f"{path}/{split}").orderBy("start").collect()
        assert [x for r in back for x in r["ids"]] == ids
        assert all(f == "metadata.json" or f.endswith(".bin") for f in os.listdir(f"{path}/{split}"))
    with open(f"{path}/metadata.json") as f:
        assert json.load(f) == known and known["disk_bytes"] == 2 * sum(map(len, splits.values()))
    assert len([f for f in os.listdir(f"{path}/train") if f.endswith(".bin")]) > 1
    with pytest.raises(Exception, match="holds token files already"):
        tokenfiles.write_token_set(found, path)
    assert read_bytes(f"{path}/train") == splits["train"]
    tokenfiles.write_tokens(spark.createDataFrame([(0, [7])], "start long, ids array<int>"), f"{path}/train", mode="overwrite")
    assert read_bytes(f"{path}/train") == [7]


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    path = str(tmp_path / "set")
    rows = spark.createDataFrame([(i, [i]) for i in range(100)], "start long, ids array<int>")
    with pytest.raises(Exception, match="token id"):
        tokenfiles.write_tokens(rows, path, vocab_size=90, files=4)
    assert not os.path.exists(path) or os.listdir(path) == []
    tokenfiles.write_tokens(rows, path, vocab_size=100, files=4)
    assert read_bytes(path) == list(range(100)) and not [f for f in os.listdir(path) if f.startswith("_")]


def brute_pairs(rows, threshold, top):
    out = set()
    kept = [(i, np.array(v, float), g) for i, v, g in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and np.linalg.norm(v) > 0]
    unit = {n: np.floor(v / np.sqrt(sum(x * x for x in v)) * similar.UNIT + 0.5) for n, (_, v, _) in enumerate(kept)}
    for n, (i, v, g) in enumerate(kept):
        hits = sorted((-int(unit[n] @ unit[m]), j) for m, (j, w, h) in enumerate(kept) if h == g and len(w) == len(v))
        for dot, j in [h for h in hits if -h[0] >= threshold * similar.UNIT**2][:top]:
            if i < j:
                out.add((i, j, -dot))
    return out


@pytest.mark.parametrize("tile, pivots", [(1024, 2048), (16, 2048), (8, 3)])
def test_similar_pairs_as_brute_force(spark, tile, pivots):
    rng = np.random.default_rng(tile)
    centres = rng.normal(0, 1, (12, 10))
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(0, 0.25, 10)], None if i % 12 == 3 else f"g{i % 3}") for i in range(400)]
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(120)]  # a large group of copies
    rows += [(2000, None, "g0"), (2001, [0.0] * 10, "g0"), (2002, [float("nan")] * 10, "g0"), (2003, [None] * 10, "g0"), (2004, [], "g0"), (2005, [1.0], "g0"), (2006, [2.0], "g0"), (None, [1.0], "g0")]
    table = spark.createDataFrame(rows, "id long, v array<double>, g string").repartition(5)
    got = similar.similar_pairs(table, "id", "v", "g", 0.92, 6, tile, pivots)
    assert {(r["a"], r["b"], round(r["score"] * similar.UNIT**2)) for r in got.collect()} == brute_pairs(rows, 0.92, 6)
    assert got.count() == len(brute_pairs(rows, 0.92, 6)) > 500


def test_similar_pairs_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, v array<float>, g int")
    assert similar.similar_pairs(empty, "id", "v", "g").count() == 0
    rows = spark.createDataFrame([(1, [1.0, 0.0], 7), (2, [1.0, 0.01], 7), (3, None, 8)], "id long, v array<float>, g int")
    found = similar.pair_summary(rows, similar.similar_pairs(rows, "id", "v", "g"), "id", "g").orderBy("g").collect()
    assert [(r["g"], r["pair_count"]) for r in found] == [(7, 1), (8, 0)] and found[0]["top_pairs"][0]["b"] == 2


def test_visits_are_pruned(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (6, 20))
    rows = [(i, [float(x) for x in centres[i % 6] + rng.normal(0, 0.02, 20)], "g") for i in range(300)]
    nodes = similar.unit_vectors(spark.createDataFrame(rows, "id long, v array<double>, g string"), "id", "v", "g").select("within", "node", "q", F.array("id").alias("ids"))
    pivots = similar._pivots(nodes, 8, 2048)
    celled = similar._celled(nodes, pivots)
    radii = {r["cell"]: r["angle"] for r in celled.groupBy("cell").agg(F.max("angle").alias("angle")).collect()}
    visits = similar._visits(celled, pivots, radii, np.arccos(0.92)).count()
    assert 300 <= visits < 300 * len(radii) / 3


def test_word_ids_are_those_of_the_expression_and_search_each_text_once(spark):
    """The ids were an expression, which was evaluated for each of their uses (F9, F15)."""
    texts = [None, "", " \t", "one two\x0bone two <|endoftext|>", "naïve \U0001f600\r\nend"]
    rows = spark.createDataFrame([(n, t, t) for n, t in enumerate(texts)], "n int, q string, t string")
    got = tokenset.word_ids(rows, {"a": "q", "b": "t"}, 8191).orderBy("n").collect()
    want = rows.select("n", tokenset.hashed_ids(F.col("t"), 8191).alias("ids")).orderBy("n").collect()
    assert [(r.n, r.a, r.b) for r in got] == [(r.n, r.ids, r.ids) for r in want]


def test_diagnosis_reads_the_rows_once(spark):
    """Counts and both distributions were made of the rows apart (F9)."""
    from corpuskiln.operators import diagnose

    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    made = [("a", [1, 2], [3, 0]), ("a", [1], [0]), ("a", [], [0]), (None, [5], [6, 7, 8])]
    rows = spark.createDataFrame(made, "by string, prompt array<int>, output array<int>").coalesce(1)
    rows = rows.mapInArrow(told, rows.schema)
    got = {r.by: r for r in diagnose.diagnosis(diagnose.features(rows, 100), "by", 0).collect()}
    assert seen.value == 4
    a, none = got["a"], got[None]
    assert (a.examples, a.problems, a.zero_supervised, a.first_is_end, a.only_end, a.end_label_ratio) == (2, 1, 0, 1, 1, 0.666667)
    assert (a.tokens_least, a.tokens_most, a.tokens_mean, a.tokens_median) == (1, 3, 2.0, 2.0)
    assert (none.examples, none.end_label_ratio, none.supervised_most, none.supervised_median) == (1, 0.0, 3, 3.0)


def test_segments_of_one_file_are_spread_over_tasks(spark):
    """All segments of a file came out of one task, where a join by file had put them (F15)."""
    made = [("one", n // 50, n, "" if n % 2 else f"line {n}") for n in range(400)] + [("bare", 0, n, " \x1c") for n in range(3)]
    rows = spark.createDataFrame(made, "file string, block int, line int, value string")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = stream.segments(rows, block="block").withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert len({r.task for r in got if r.file == "one"}) > 1
    assert sorted((r.segment, r.text) for r in got if r.file == "one") == [(n, f"line {2 * n}\n{MARK}\n") for n in range(200)]
    assert [(r.segment, r.text) for r in got if r.file == "bare"] == [(0, f"{MARK}\n")]
