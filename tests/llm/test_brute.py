"""Operators against direct versions of what they compute."""

import collections
import hashlib
import itertools
import json
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskiln.llm import audio, bpe, imatch, packing, secrets, toxicity, urltree

SMALL = "/root/testdata/sf0.001"


def test_resampling_is_direct_convolution():
    rng = np.random.default_rng(1)
    x = rng.standard_normal(300).astype("f4")
    up = np.zeros(2 * len(x))
    up[::2] = x
    n = np.arange(24) - 11.5
    taps = np.sinc(n / 3) * np.hanning(26)[1:-1]
    for phase in range(2):  # unit gain of each phase
        taps[phase::2] /= taps[phase::2].sum()
    whole = np.convolve(up, taps)
    # output i is the filtered signal at common-rate place 3 i, the filter's middle there
    wanted = [whole[3 * i + 12 - (3 * i) % 2 + (3 * i) % 2] for i in range(len(x) * 2 // 3)]
    assert np.abs(audio.resample(x) - np.array(wanted)).max() < 1e-5


def test_log_mel_is_a_direct_transform():
    rng = np.random.default_rng(2)
    x = rng.standard_normal(1000).astype("f4")
    mels, energy = audio.log_mel(x)
    assert len(mels) == (1000 - 400) // 160 + 1
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(400) / 400)
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(mel(20), mel(8000), 42)]
    for i in range(len(mels)):
        frame = x[160 * i : 160 * i + 400] * window
        power = [abs(sum(frame * np.exp(-2j * np.pi * k * np.arange(400) / 512))) ** 2 for k in range(257)]
        for m in range(40):
            low, middle, high = edges[m : m + 3]
            total = sum(p * max(0, min((k * 31.25 - low) / (middle - low), (high - k * 31.25) / (high - middle))) for k, p in enumerate(power))
            assert abs(mels[i, m] - math.log(total + 1e-6)) < 1e-3
        assert abs(energy[i] - math.log((frame**2).mean() + 1e-9)) < 1e-4


def test_segments_are_a_state_machine():
    rng = np.random.default_rng(3)
    for _ in range(50):
        energy = rng.standard_normal(rng.integers(1, 60)).cumsum()
        low, high = np.quantile(energy, [0.1, 0.9])
        upper, lower = low + 0.6 * (high - low), low + 0.3 * (high - low)
        on, start, wanted = False, 0, []
        for i, e in enumerate(energy):
            if not on and e >= upper:
                on, start = True, i
            elif on and e < lower:
                on = False
                wanted.append((start, i))
        if on:
            wanted.append((start, len(energy)))
        assert audio.segments(energy) == wanted


def test_secret_spans_are_brute_force(spark):
    rng = random.Random(4)
    parts = ["password", "PASSWD", "secret", "Token", "api_key", "apikey", "\"", "'", " ", ":", "=", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "eyJabcdefgh1", ".", "Bearer ", "https://u:pwd@h", "é", "\n", "K"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(spark.read.parquet(f"{SMALL}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    base = [("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16)]
    got = {r["doc_id"]: r for r in secrets.scan_digests(docs).collect()}
    for r in docs.collect():
        text, mine = r["text"] or "", got[r["doc_id"]]
        spans = sorted((m.start(), i, m.end()) for i, (_, p, g, least) in enumerate(base) for m in p.finditer(text) if len(m[g]) >= least)
        assert mine["base_sha256"] == hashlib.sha256(",".join(f"{base[i][0]}:{a}:{b}" for a, i, b in spans).encode()).hexdigest()
        assert [mine[f"n_{b[0]}"] for b in base] == [sum(i == k for _, i, _ in spans) for k in range(3)]
        every = sorted((m.start(), i, m.end()) for i, rule in enumerate(secrets.RULES) for m in re.finditer(rule.pattern, text) if len(m[rule.group]) >= rule.least)
        assert mine["spans"] == ",".join(f"{secrets.RULES[i].kind}:{a}:{b}" for a, i, b in every)


def kernel(s, t):
    """Sum over common subsequences of ORDER letters, each discounted by its span in both words."""
    spans = lambda w: [("".join(w[i] for i in c), c[-1] - c[0] + 1) for c in itertools.combinations(range(len(w)), toxicity.ORDER)]
    return sum(toxicity.DECAY ** (a + b) for (x, a), (y, b) in itertools.product(spans(s), spans(t)) if x == y)


def test_kernel_is_direct():
    words = ["idiot", "idixot", "iidiot", "worthless", "trash", "thrash", "aaaaaa", "zwölf"]
    landmarks = toxicity.Landmarks(["idiot", "trash", "aaaaaa"])
    for w, row in zip(words, landmarks.values(words), strict=True):
        for mark, value in zip(landmarks.words, row, strict=True):
            assert value == pytest.approx(kernel(w, mark) / math.sqrt(kernel(w, w) * kernel(mark, mark)), abs=1e-4)
    weights = np.array([0.5, -2.0, 1.5])
    assert landmarks.weighted(weights).values(words)[:, 0] == pytest.approx(landmarks.values(words) @ weights, abs=1e-4)


def test_toxicity_holds_on_the_tables(spark):
    """Nearly all toxic rows that trained are caught on the second smallest table, and clean ones are left alone."""
    path = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.scores(docs, labels).join(labels, "doc_id").collect()
    caught = [r["predicted"] for r in rows if r["toxic"] == 1 and not r["held_out"]]
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert sum(caught) >= 0.9 * len(caught) and sum(clean) <= 0.05 * len(clean)


def test_pieces_are_the_library_s(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    library.no_truncation()
    library.no_padding()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    wanted = set()
    for r in docs.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 256)):
            cut = ids[start : start + 256]
            wanted.add((r["doc_id"], piece, start, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())))
    got = packing.pack_documents(docs, capacity=256).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == wanted and len(got) == len(wanted)
    assert len({r["sequence_id"] for r in got}) <= math.ceil(sum(w[3] for w in wanted) / 256) * 1.02 + 1


def test_vocabulary_file_is_of_the_kind_that_is_read():
    with open(bpe.default_path(), encoding="utf-8") as f:
        assert json.load(f)["model"]["type"] == "BPE"


# --- url tree -------------------------------------------------------------------------------------------------------


def general(segment):
    stem, ext = re.fullmatch(r"(.*?)(\.[A-Za-z0-9]{1,5})?", segment, re.S).groups()
    varies = re.fullmatch("[0-9]+", stem) or re.fullmatch("[0-9a-fA-F-]{12,}", stem) or (re.search("[0-9]", stem) and len(stem) > 16) or len(stem) > 48
    return "*" + (ext or "") if varies else segment


def tree_verdicts(urls):
    """(template, purity, verdict) of each url, by an explicit tree."""
    rows = []
    for url in urls:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0].lower()
        path = re.split("[?#]", rest[len(host) :])[0]
        fits = [r for r in urltree.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.text), default=None)
        rows.append([host, tuple(general(s) for s in path.split("/") if s), rule])
    templates = [""] * len(rows)
    for level in range(max(len(r[1]) for r in rows)):
        children = collections.defaultdict(collections.Counter)
        for (host, levels, _), t in zip(rows, templates, strict=True):
            if len(levels) > level:
                children[host, t][levels[level]] += 1
        new = list(templates)
        for i, ((host, levels, _), t) in enumerate(zip(rows, templates, strict=True)):
            if len(levels) > level:
                c = children[host, t]
                wide = len(c) > urltree.MANY and sum(c.values()) < urltree.FEW * len(c)
                new[i] = t + "/" + ("*" if wide and not levels[level].startswith("*") else levels[level])
        templates = new
    site = lambda h: (re.search(r"(?:^|\.)([^.]+\.(?:(?:co|com|org|net|ac|gov|edu)\.[a-z]{2}|[^.]+))$", h) or [h, h])[1]
    labelled = [(r[0], t, r[2].verdict == "block") for r, t in zip(rows, templates, strict=True) if r[2]]

    def count(fits):
        found = [b for h, t, b in labelled if fits(h, t)]
        return len(found), sum(found)

    def information(n, b):
        return sum(k * math.log(k / n) for k in (b, n - b) if k)

    out = []
    for (host, _, rule), template in zip(rows, templates, strict=True):
        steps = template.split("/")[1:]
        chain = [count(lambda h, t: True)]
        for k in range(1, len(steps) + 1):
            prefix = "/" + "/".join(steps[:k])
            chain.append(count(lambda h, t, p=prefix: t == p or t.startswith(p + "/")))
        tld = host.rsplit(".", 1)[-1]
        chain.append(count(lambda h, t: t == template and h.rsplit(".", 1)[-1] == tld))
        chain.append(count(lambda h, t: t == template and site(h) == site(host)))
        chain.append(count(lambda h, t: t == template and h == host))
        p = chain[0][1] / chain[0][0] if chain[0][0] else 0.0
        for (wn, wb), (n, b) in itertools.pairwise(chain):
            if n and wn > n and 2 * (information(n, b) + information(wn - n, wb - b) - information(wn, wb)) >= urltree.CRITICAL:
                p = (b + urltree.PRIOR * p) / (n + urltree.PRIOR)
        out.append((template, round(p, 6), rule.verdict if rule else "block" if round(p, 6) >= urltree.BLOCK else "allow"))
    return out


def test_url_tree_is_brute_force(spark):
    rng = random.Random(6)
    hosts = ["www.example.org", "a.org", "b.com", "m.b.com", "f.com", "g.com", "h.com", "c.net", "shop.c.net", "d.co.uk", "x.d.co.uk", "e.info"]
    urls = []
    for _ in range(700):
        depth = rng.choice([1, 1, 2, 3, 7])
        first = rng.choice(["de", "fr", "es", "en", "news"])
        rest = [rng.choice([str(rng.randint(1, 300)), "user" + "".join(rng.choice("abcdef") for _ in range(4)), "list", f"{rng.randint(1, 9)}.html"]) for _ in range(depth)]
        urls.append(f"http://{rng.choice(hosts)}/" + "/".join([first, *rest]) + rng.choice(["", "/", "?q=1", "#t"]))
    got = {r["page_id"]: r for r in urltree.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    wanted = tree_verdicts(urls)
    for i, (template, purity, verdict) in enumerate(wanted):
        assert (got[i]["template"], got[i]["verdict"]) == (template, verdict)
        assert got[i]["purity"] == pytest.approx(purity, abs=2e-6)
    assert len({r["purity"] for r in got.values() if r["rule"] is None}) > 3
    assert {r["verdict"] for r in got.values() if r["rule"] is None} == {"allow", "block"}
    assert any(t.count("/") > 4 for t, _, _ in wanted) and any("/*/" in t for t, _, _ in wanted)


# --- document fingerprints ------------------------------------------------------------------------------------------


def test_imatch_is_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    split = lambda t: {x for x in re.split(r"[\W_]+", t.lower()) if x}
    counts = collections.Counter(x for _, t in rows for x in split(t))
    band = {x for x, n in counts.items() if max(2, len(rows) / imatch.RARE) <= n <= max(2, len(rows) / imatch.COMMON)}
    term = F.col("term")
    hashed = spark.createDataFrame([(x,) for x in band], "term string").select("term", imatch.term_hash(term).alias("h")).select("term", "h", imatch.part(F.col("h")).alias("part"), imatch.extra(F.col("h")).alias("extra"), F.xxhash64("h").alias("mixed"))
    facts = {r["term"]: r for r in hashed.collect()}
    assert len({r["extra"] for r in facts.values()}) > 4 and {r["part"] for r in facts.values()} == set(range(imatch.PARTS))

    def slots(text):
        out = collections.defaultdict(int)
        for x in split(text) & band:
            r = facts[x]
            for k in {r["part"], r["extra"]} - {-1}:
                out[k] ^= r["mixed"] & (2**64 - 1)
        return {k: v >> 32 for k, v in out.items()}

    def shown(text):
        found = sorted(slots(text).items())
        return "-".join(f"{k << 32 | v:010x}" for k, v in found) or hashlib.sha256(text.encode()).hexdigest()[:16]

    def alike(a, b):
        x, y = slots(a), slots(b)
        used = set(x) | set(y)
        return sum(x.get(k) == y.get(k) for k in used) / len(used) if used else float(a == b)

    got = {r["doc_id"]: r for r in imatch.fingerprint_digests(docs).collect()}
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        n = len(t) // 2
        edited = t[: len(t) - n] + following[:n]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (shown(t), shown(edited))
        assert r["near_edited"] == pytest.approx(alike(t, edited)) and r["near_next"] == pytest.approx(alike(t, following))
