"""Phrases, vector codes and id files against brute force, round trips, and awkward rows."""

import collections
import heapq
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuskiln.llm import idfiles, phrases, toxicity, urltree, vectorcodes
from corpuskiln.llm.common import new_path

BIG = 2**60 + 1
CLASH = ("phrase", "f", "range", "n", "k", "rank", "id", "v", "of", "code", "file", "hash", "ids", "place", "record", "a.b")
LONG = "the long tail. " * 20_000


def clashing(df):
    return df.select("*", *[F.lit(f"{c} of the caller").alias(c) for c in CLASH])


def brute_phrases(rows, most=3, least=10, top=2000, cover=50):
    counts, words = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    counts[lang, tuple(w[i : i + k])] += 1
    candidates = {p: a for p, a in counts.items() if a >= least and len(p[1]) > 1}
    within = collections.Counter()
    for (lang, w), a in candidates.items():
        for n in range(2, len(w)):
            for i in range(len(w) - n + 1):
                within[lang, w[i : i + n]] = max(within[lang, w[i : i + n]], a)
    out = collections.defaultdict(list)
    for (lang, w), a in candidates.items():
        if (lang, w) in within and 100 * within[lang, w] >= cover * a:
            continue
        cuts = [(1_000_000 * a * a // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
    return {(lang, i, p.decode(), -a, lo, r, words[lang], -s) for lang, found in out.items() for i, (s, a, p, lo, r) in enumerate(sorted(found)[:top], 1)}


def phrase_rows(found):
    return {(r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in found.collect()}


PHRASE_ROWS = [
    *[("en", "New York is big. new york, IS small!\nA b\tc  A B C;A b")] * 12,
    *[(None, "x y z x y z é É x y")] * 7,
    *[("und", "x y z. x y")] * 6,
    ("en", None), ("en", ""), ("en", " .,;\n\t"), (None, None), ("", "in a nameless language " * 11), ("en", LONG), ("en", "nul\x00word nul\x00word " * 12),
    *[("de", f"w{i % 7} w{i % 5} w{i % 3} zzz{i}") for i in range(400)],
]


@pytest.fixture(scope="module")
def phrase_docs(spark):
    return clashing(spark.createDataFrame(PHRASE_ROWS, "lang string, text string")).repartition(5)


@pytest.mark.parametrize("most, top", [(3, 2000), (2, 3), (5, 7)])
def test_phrases_as_brute_force(phrase_docs, most, top):
    assert phrase_rows(phrases.collocations(phrase_docs, most_words=most, top=top)) == brute_phrases(PHRASE_ROWS, most, top=top)


def test_a_full_bit_table_changes_nothing(phrase_docs):
    texts = phrase_docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    full = phrases.FrequentBits(phrases.LEAST_BITS, b"\xff" * (phrases.LEAST_BITS // 8))
    pairs = phrases.level(texts, 1, 10).where("phrase IS NOT NULL")
    real = phrases.frequent_bits(pairs.select("lang", "phrase"), 1)
    assert 0 < np.unpackbits(real.table).sum() < 4 * pairs.count()
    shown = [sorted(map(tuple, phrases.level(texts, 2, 10, bits).collect())) for bits in (full, real)]
    assert shown[0] == shown[1] and shown[0]


def test_phrases_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("en", " ")], "lang string, text string")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 80), st.integers(1, 5), st.sampled_from([2, 40, 2**26 - 1]), st.integers(0, 2**32 - 1))
def test_vantage_tree_finds_the_nearest_with_ties(n, width, reach, seed):
    rng = np.random.default_rng(seed)
    entries, points = (rng.integers(-reach, reach + 1, (k, width)) for k in (n, 200))
    entries[n // 2 :: 3] = entries[0]  # entries that repeat
    index, apart = vectorcodes.VantageTree(entries).nearest(points)
    all_apart = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (apart == all_apart.min(axis=1)).all() and (index == all_apart.argmin(axis=1)).all()


def brute_codes(rows, parts, entries, rounds):
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((r for r in kept if r[1] and len(r[1]) % parts == 0 and max(map(abs, r[1])) < 2**26), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(order[0][1])
    fits = [r for r in order if len(r[1]) == size]
    w = size // parts
    cut = lambda v, p: v[p * w : p * w + w]
    book = [[cut(r[1], p) for r in fits[:entries]] for p in range(parts)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)), j) for j, e in enumerate(book[p]))
    for _ in range(rounds):
        found = [[near(r[1], p)[1] for p in range(parts)] for r in fits]
        for p in range(parts):
            moved = list(book[p])
            for j in range(len(moved)):
                own = [cut(r[1], p) for r, f in zip(fits, found, strict=True) if f[p] == j]
                if own:
                    moved[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
            book[p] = moved
    out, errors = [], collections.Counter()
    for i, v, label in kept:
        if len(v) == size and max(map(abs, v)) < 2**26:
            best = [near(v, p) for p in range(parts)]
            error = sum(d for d, _ in best)
            errors[label] += error
            out.append([i, label, bytes(j for _, j in best).hex(), error])
        else:
            out.append([i, label, None, None])
    fitting = {label for _, label, code, _ in out if code is not None}
    return collections.Counter((*r, errors[r[1]] if r[1] in fitting else None) for r in out), book


def vector_rows(n, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(0, 1, 8), 2)], int(rng.integers(0, 3))) for i in rng.permutation(n)]
    rows += [(BIG, [0.5] * 8, None), (None, [0.25] * 8, None), (None, None, 1), (3, [0.1] * 8, 9), (3, [0.1] * 8, 9), (3, [-0.1] * 8, 9)]
    rows += [(900, [float("nan")] * 8, 1), (901, [float("inf")] + [0.0] * 7, 1), (902, [None] + [0.0] * 7, 1), (903, [], 5), (904, [1.0] * 6, 5), (905, [1.0] * 16, 1), (906, [2.0**20] * 8, 1)]
    return rows


@pytest.mark.parametrize("n, entries", [(150, 64), (5, 64), (150, 7)])
def test_vector_codes_as_brute_force(spark, n, entries):
    rows = vector_rows(n, n)
    table = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4))
    found, book = vectorcodes.compress(table, parts=4, entries=entries)
    got = collections.Counter((r["id"], r["label"], r["code"].hex() if r["code"] is not None else None, r["error"], r["label_error"]) for r in found.collect())
    wanted, wanted_book = brute_codes(rows, 4, entries, 2)
    assert book.tolist() == wanted_book and got == wanted
    back = vectorcodes.decoded(found.where("code IS NOT NULL"), book).select("code", "approximation").first()
    assert back["approximation"] == [x / 256 for p, j in enumerate(back["code"]) for x in wanted_book[p][j]]


def test_vector_codes_of_nothing(spark):
    for rows in ([], [(1, None, 2)]):
        found, book = vectorcodes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
        assert found.count() == 0 and book.size == 0
    found, _ = vectorcodes.compress(spark.createDataFrame([(1, [], 2), (2, [1.0], None)], "vec_id long, embedding array<float>, label int"))
    assert [tuple(r) for r in found.orderBy("id").collect()] == [(1, 2, None, None, None), (2, None, None, None, None)]


def huffman_cost(counts):
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        total += x
        heapq.heappush(heap, x)
    return total


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=2, max_size=60), st.integers(6, 18))
def test_code_lengths_are_a_best_prefix_code(counts, limit):
    counts = np.array(counts)
    lengths = idfiles.code_lengths(counts, limit)
    used = lengths[counts > 0]
    assert (lengths[counts == 0] == 0).all() and used.max(initial=0) <= limit
    if len(used) > 1:
        assert sum(2.0 ** -int(x) for x in used) == 1
        free = int((idfiles.code_lengths(counts, 59 if len(used) < 60 else 18).astype("i8") * counts).sum())
        assert free == huffman_cost(counts) <= int((lengths.astype("i8") * counts).sum())


def test_limited_lengths_as_brute_force():
    for counts in ([1, 1, 2, 4, 8, 16], [5, 1, 1, 1, 20], [1, 100, 1, 100, 1]):
        for limit in (3, 4):
            best = min(sum(c * x for c, x in zip(counts, ls, strict=True)) for ls in itertools.product(range(1, limit + 1), repeat=len(counts)) if sum(2.0**-x for x in ls) <= 1)
            assert int((idfiles.code_lengths(np.array(counts), limit).astype("i8") * counts).sum()) == best


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 1000), st.integers(1, 3000), st.integers(0, 2**32 - 1))
def test_bits_come_back(n, symbols, seed):
    rng = np.random.default_rng(seed)
    ids = np.minimum((rng.pareto(0.7, n) * 2).astype("i8"), symbols - 1)
    codes = idfiles.Codes(idfiles.code_lengths(np.bincount(ids, minlength=symbols)))
    bits, offsets = codes.encode(ids)
    assert (codes.decode(bits, offsets, n) == ids).all()
    assert len(offsets) == -(-n // idfiles.BLOCK_IDS)
    for block in range(len(offsets)):  # each alone
        own = ids[block * idfiles.BLOCK_IDS : (block + 1) * idfiles.BLOCK_IDS]
        assert (codes.decode(bits, offsets[block : block + 1], len(own)) == own).all()


ID_ROWS = [(BIG, "a plain text of some words"), (None, "a plain text of some words"), (None, None), (7, "b"), (7, "a"), (7, "a"), (-5, ""), (BIG + 1, None), (3, LONG), (12, "<|endoftext|> é ſ \x1c"), *[(i, f"copy {i % 9}") for i in range(100, 400)]]


@pytest.fixture
def small_files(monkeypatch):
    monkeypatch.setattr(idfiles, "FILE_IDS", 300)
    monkeypatch.setattr(idfiles, "SEGMENT_IDS", 50)


def test_id_files_as_the_library(spark, small_files):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_padding(), library.no_truncation()
    docs = clashing(spark.createDataFrame(ID_ROWS, "doc_id long, text string").repartition(3))
    path = new_path(spark, "idfiles-test")
    idfiles.store_ids(docs, path)
    found = idfiles.read_files(spark, path).join(idfiles.file_starts(spark, path), "file").selectExpr("file", "doc_id", "before + start AS start", "n_tokens", "ids").orderBy("start").collect()
    wanted = collections.Counter((i, np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in ID_ROWS)
    assert collections.Counter((r["doc_id"], bytes(r["ids"])) for r in found) == wanted
    assert [r["doc_id"] for r in found] == sorted((i for i, _ in ID_ROWS), key=lambda i: (i is None, i or 0))
    assert [r["file"] for r in found] == sorted(r["file"] for r in found) and found[-1]["file"] > 3
    at = 0
    for r in found:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]) // 4)
        at += r["n_tokens"]
    names = [r["path"].rsplit("/", 1)[-1] for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/ids").select("path").collect()]
    assert len(names) == len({n[:10] for n in names})


def test_id_files_of_nothing(spark):
    path = new_path(spark, "idfiles-test")
    idfiles.store_ids(spark.createDataFrame([], "doc_id long, text string"), path)
    assert idfiles.read_files(spark, path).join(idfiles.file_starts(spark, path), "file").count() == 0


def test_a_changed_file_is_an_error():
    ids = np.arange(500) % 7
    codes = idfiles.Codes(idfiles.code_lengths(np.bincount(ids)))
    whole = idfiles.segment(codes, 0, np.array([4]), np.array([True]), np.array([500]), ids) + b"\n"
    import struct

    last = struct.pack(idfiles.LAST, idfiles.TAIL, 0, 1, 500) + b"\n"
    assert (next(idfiles.segments(memoryview(whole + last), codes))[4] == ids).all()
    for bad in (whole[:60] + bytes([whole[60] ^ 1]) + whole[61:] + last, whole[:90], last, whole):
        with pytest.raises(ValueError):
            list(idfiles.segments(memoryview(bad), codes))
    assert zlib.crc32(whole[:-5]) == int.from_bytes(whole[-5:-1], "little")


def brute_templates(counts, many=20, few=8.0):
    """Level by level, each host's nodes by the templates of the levels above."""
    found = {key: "" for key in counts}
    for i in range(max(len(levels) for _, levels in counts)):
        children = collections.defaultdict(collections.Counter)
        for (host, levels), n in counts.items():
            if len(levels) > i:
                children[host, found[host, levels]][levels[i]] += n
        wide = {k for k, c in children.items() if len(c) > many and sum(c.values()) < few * len(c)}
        for (host, levels), template in list(found.items()):
            if len(levels) > i:
                star = (host, template) in wide and not levels[i].startswith("*")
                found[host, levels] = f"{template}/{'*' if star else levels[i]}"
    return found


def test_url_templates_of_any_depth(spark):
    """Wide nodes within wide nodes and beside them, wildcards by form among them, and a path of 2000 segments."""
    import random
    import time

    rng = random.Random(4)
    word = lambda k: rng.choice("abcdefgh") * k
    counts = collections.Counter()
    for host in ("one", "two"):
        for i in range(300):
            counts[host, ("top", f"v{i % 40}", rng.choice(["x", "y"]), f"w{rng.randrange(200)}", word(2))] += 1
            counts[host, (f"q{i % 30}", "*", f"z{i}")] += rng.randrange(1, 3)
            counts[host, (rng.choice(["few", "*.html"]), word(1))] += 5
        counts[host, ()] += 3
    counts["deep", tuple(f"s{i}" for i in range(2000))] += 1
    counts["deep", tuple(f"s{i}" for i in range(1999))] += 2
    tree = spark.createDataFrame([(h, list(ls), n) for (h, ls), n in counts.items()], "host string, levels array<string>, n long").repartition(3)
    start = time.time()
    got = {(r["host"], tuple(r["levels"])): r["template"] for r in urltree.merged(tree).collect()}
    assert got == brute_templates(counts)
    assert time.time() - start < 60
    assert {t.count("*") for t in got.values()} >= {0, 1, 2}


def test_training_takes_a_rare_clean_word_near_an_insult():
    """It joins the examples wherever it stands among thousands of others."""
    import random

    rng = random.Random(7)
    syllables = ["ba", "ko", "ri", "tu", "me", "sol", "ven", "da", "pli", "gor"]
    fresh = sorted({"".join(rng.choices(syllables, k=4)) for _ in range(9000)})[:6500]
    docs = [["plain", "words", *fresh[i * 13 : i * 13 + 13]] for i in range(500)] + [["plain", "scumbog"]] * 2
    docs += [["plain", "words", "scumbag"]] * 40
    labels = [0] * 502 + [1] * 40
    model = toxicity.train_words(docs, labels)
    assert model.probability(model.margins(["scumbag"]))[0] > 0.5
    assert model.margins(["scumbog"])[0] < model.margins(["scumbag"])[0] and (model.margins(fresh) < 0).all()
