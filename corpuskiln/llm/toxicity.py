"""Operator 3: toxicity by a subsequence-kernel support vector machine with Nystrom landmarks.

The kernel compares words (and runs of single letters joined up, as in ``i d i o t``) by their common subsequences of
``ORDER`` letters, each discounted by ``DECAY`` for every letter that it spans, gaps included, and normalised; a word
with an inserted or dropped character stays close to the plain one.  ``LANDMARKS`` words span the feature space: a word
maps to its kernel values with them times the inverse root of their own kernel matrix (Nystrom), where a linear
support vector machine is trained.  Labels belong to documents, so training takes several instances to a label: words
of clean documents are clean examples, first frequent ones, then those that the machine takes for toxic; of toxic
documents the words typical of them (by likelihood ratio, above what chance gives among so many words) are examples as
long as the machine agrees, and of toxic documents without such a word the one that comes nearest.
A document's score is a logistic function of its worst word, fitted on the same training rows.

Only labelled rows with crc32(doc_id) mod 5 <> 0 train, and of these the ``SAMPLE`` with the least hash of the id
(a documented bound on rows: documents beyond it change the machine little); of each its distinct words, found in
Spark, are gathered, however long the text is.  Everything else covers all rows and whole texts.
A word's margin does not depend on its document, so a task keeps a table of margins by word, bounded in bytes and given
up when the task ends.

Defined results: null, empty and wordless texts get the score of a text without any word, below 0.5; very long texts
are scored whole, like any; equal texts get equal scores (ties too); repeated rows repeat; of several labels of an id
the larger counts, of several labelled rows of an id that with the least hash of its text trains; null ids are never
held out and never train, ids of any size come back as they are; a table without labelled rows of both kinds scores
every text 0; other columns, whatever their names, pass through ``drop_toxic`` unchanged; an empty table gives an
empty table.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from copy import copy
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SetAside, map_texts, materialize, whole_text

ORDER, DECAY = 4, 0.6
LANDMARKS = 256
#: Training documents at most, a third of them toxic.
SAMPLE = 6000
LONGEST = 20
#: Likelihood ratio from which a word counts as typical of toxic documents, at most; fewer words ask for less.
TYPICAL = 24.0
ROUNDS = 5
#: The machine's working set: typical words at most, clean words at first (the most frequent), clean words that join in a
#: round (the least clean by its margin), and those of them that become landmarks.  Training on the sample alone is bounded by it;
#: which words and documents are scored is not.
TYPICAL_WORDS, CLEAN_WORDS, JOINING, MARKING = 3000, 4000, 3000, 40
SINGLES = regex.compile(r"(?<![\p{L}\p{N}])(?:\p{L}[\s._*-]{1,2}){3,}\p{L}(?![\p{L}\p{N}])")
LETTERS = regex.compile(r"[^\p{L}]+")
#: Bytes that a task's table of margins may take, and those of an entry beside its characters.
TABLE_BYTES, ENTRY_BYTES = 48_000_000, 190


def runs(text: str) -> set[str]:
    """Distinct runs between white space, lower case; letters set apart are joined to runs as well."""
    low = text.lower()
    out = set(low.split())
    if sum(1 for x in out if len(x) == 1) >= 3:
        out.update(LETTERS.sub("", m) for m in SINGLES.findall(low))
    return out


def letters(run: str) -> list[str]:
    """The run's letters as one word, in overlapping parts if long; none if there are fewer than the kernel's order."""
    word = run if run.isalpha() else LETTERS.sub("", run)
    if len(word) <= LONGEST:
        return [word] if len(word) >= ORDER else []
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


@cache
def subsequences(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all subsequences of a word of n letters (ORDER rows), and the discount of each."""
    places = np.array(list(combinations(range(n), ORDER))).T
    return places, (DECAY ** (places[-1] - places[0] + 1)).astype("f4")


def by_length(words: list[str], most: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of words of one length, their code points)."""
    groups: dict[int, list[int]] = {}
    for number, word in enumerate(words):
        groups.setdefault(len(word), []).append(number)
    for n, numbers in groups.items():
        for a in range(0, len(numbers), most):
            part = numbers[a : a + most]
            yield np.array(part), np.frombuffer("".join([words[x] for x in part]).encode("utf-32-le"), "<u4").reshape(-1, n)


def norms(codes: np.ndarray) -> np.ndarray:
    """Root of the kernel of each word with itself, by the usual dynamic programme over both, for equal lengths."""
    m, n = codes.shape
    before = [np.ones((m, n + 1), "f4")] + [np.zeros((m, n + 1), "f4") for _ in range(ORDER - 1)]
    total, d = np.zeros(m, "f4"), np.float32(DECAY)
    for s in range(n):
        same = (codes[:, s, None] == codes).astype("f4") * (d * d)
        total += (before[ORDER - 1][:, :-1] * same).sum(axis=1)
        for i in range(ORDER - 1, 0, -1):
            inner, add = np.zeros((m, n + 1), "f4"), same * before[i - 1][:, :-1]
            for t in range(n):
                inner[:, t + 1] = d * inner[:, t] + add[:, t]
            before[i] = d * before[i] + inner
    return np.sqrt(total)


class Landmarks:
    """Landmark words by their subsequences, which are numbered from 1; 0 stands for all others."""

    def __init__(self, words: list[str]):
        self.words = words
        alphabet = sorted(set("".join(words)))
        self.size = len(alphabet) + 1
        self.table = np.zeros(max(map(ord, alphabet), default=0) + 2, "i8")
        self.table[[ord(c) for c in alphabet]] = np.arange(1, self.size)
        found = [(numbers, codes, self.spelled(codes)) for numbers, codes in by_length(words)]
        self.known = np.unique(np.concatenate([np.array([-1])] + [x.ravel() for *_, x in found]))
        self.features = np.zeros((len(self.known), len(words)), "f4")
        for numbers, codes, spelled in found:
            scale, (_, discount) = norms(codes), subsequences(codes.shape[1])
            for row, number in enumerate(numbers):
                np.add.at(self.features[:, number], np.searchsorted(self.known, spelled[row]), discount / scale[row])
        self.features[0] = 0
        self.number = np.zeros(self.size**ORDER, "i4")
        self.number[self.known[1:]] = np.arange(1, len(self.known))

    def spelled(self, codes: np.ndarray) -> np.ndarray:
        """The number of each subsequence of each word; -1 if it has a letter of no landmark."""
        c = self.table[np.minimum(codes, len(self.table) - 1)]
        places, _ = subsequences(codes.shape[1])
        out, whole = np.zeros((len(codes), places.shape[1]), "i8"), np.ones((len(codes), places.shape[1]), bool)
        for p in places:
            out = out * self.size + c[:, p]
            whole &= c[:, p] > 0
        return np.where(whole, out, -1)

    def weighted(self, weights: np.ndarray) -> Landmarks:
        """The same with a weighted sum of kernel values in place of the values, which takes little memory.

        The sum is linear in a word's subsequences, so it is one look-up for each of them.
        """
        out = copy(self)
        out.features = (self.features @ weights.astype("f4"))[:, None]
        return out

    def values(self, words: list[str]) -> np.ndarray:
        """Normalised kernel values of words with the landmarks, or their weighted sum."""
        features = self.features
        out = np.zeros((len(words), features.shape[1]), "f4")
        for numbers, codes in by_length(words):
            _, discount = subsequences(codes.shape[1])
            step = max(1, (20_000 if features.shape[1] > 1 else 400_000) // len(discount))
            for a in range(0, len(codes), step):
                part = codes[a : a + step]
                spelled = self.spelled(part)
                taken = features[np.where(spelled < 0, 0, self.number[spelled])]
                out[numbers[a : a + len(part)]] = np.einsum("wtm,t->wm", taken, discount) / norms(part)[:, None]
        return out


@dataclass
class Model:
    landmarks: Landmarks  # weighted: Nystrom map and machine in one
    bias: float
    slope: float = 1.0
    offset: float = 0.0
    empty: float = -3.0

    def margins(self, words: list[str]) -> np.ndarray:
        return self.landmarks.values(words)[:, 0] + self.bias

    def run_margins(self, new: list[str]) -> np.ndarray:
        """Margin of each run: that of its worst part."""
        parts = [letters(r) for r in new]
        flat = [w for p in parts for w in p]
        owner = np.repeat(np.arange(len(new)), [len(p) for p in parts])
        out = np.full(len(new), self.empty)
        np.maximum.at(out, owner, self.margins(flat))
        return out

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 600, c: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear support vector machine, squared hinge, by accelerated gradient steps; y is -1 or 1."""
    z = np.hstack([x, np.ones((len(x), 1))])
    rate = 1 / (2 * float(np.linalg.norm((z * weight[:, None]).T @ z, 2)) + c)
    v, last = np.zeros(z.shape[1]), np.zeros(z.shape[1])
    for i in range(steps):
        u = v + i / (i + 3) * (v - last)
        slack = np.maximum(0, 1 - y * (z @ u))
        last, v = v, u - rate * (c * u * np.append(np.ones(x.shape[1]), 0) - 2 * z.T @ (weight * y * slack))
    return v[:-1], float(v[-1])


def _ratio(toxic: np.ndarray, clean: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Signed likelihood ratio of a word's counts in toxic and clean documents."""
    total = toxic + clean
    share = n1 / (n1 + n0)
    term = lambda k, e: np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / e), 0)
    return np.sign(toxic - total * share) * 2 * (term(toxic, total * share) + term(clean, total * (1 - share)))


def train(texts: list[str], labels: list[int], landmarks: int = LANDMARKS) -> Model | None:
    """A model from labelled texts; None without both labels or without words."""
    return train_words([instances(t) for t in texts], labels, landmarks)


def instances(text: str) -> list[str]:
    """The distinct words of a text, in order."""
    return sorted({w for r in runs(text) for w in letters(r)})


def train_words(docs: list[list[str]], labels: list[int], landmarks: int = LANDMARKS) -> Model | None:
    """A model from the words of labelled documents; None without both labels or without words."""
    y = np.asarray(labels)
    if not len(y) or y.min() == y.max():
        return None
    seen: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
    for d, label in zip(docs, labels, strict=True):
        seen[label].update(d)
    if not seen[0] or not seen[1]:
        return None
    suspects = sorted(seen[1])
    ratio = dict(zip(suspects, _ratio(np.array([seen[1][w] for w in suspects], "f8"), np.array([seen[0][w] for w in suspects], "f8"), int(y.sum()), int((1 - y).sum())).tolist(), strict=True))
    ordered = sorted(suspects, key=lambda w: (-ratio[w], w))
    # what the largest of so many ratios would be by chance
    typical = min(TYPICAL, 2 * np.log(1 + sum(seen[0][w] + seen[1][w] > 2 for w in suspects)))
    likely = [w for w in ordered if ratio[w] >= typical][:TYPICAL_WORDS] or ordered[:20]
    found = set(likely)
    for d, label in zip(docs, labels, strict=True):
        if label and d and found.isdisjoint(d):
            best = min(d, key=lambda w: (-ratio[w], w))
            if ratio[best] >= typical / 2 and not seen[0][best]:
                likely.append(best)
                found.add(best)
    clean = sorted((w for w in seen[0] if ratio.get(w, 0) < typical / 2), key=lambda w: (-seen[0][w], w))
    if not clean:
        return None
    spread = clean[:: max(1, len(clean) // landmarks)]
    # landmarks: typical words and clean ones from frequent to rare; then clean ones that look toxic in their place
    marks = likely[: landmarks // 2]
    marks = (marks + [w for w in spread if w not in set(marks)])[:landmarks]
    negative, hard, model = clean[:CLEAN_WORDS], [], None
    for _ in range(ROUNDS):
        basis = model = None  # the last round's tables go before the next are made
        basis = Landmarks(marks)
        value, vector = np.linalg.eigh(basis.values(marks).astype("f8"))
        keep = value > 1e-4
        root = vector[:, keep] / np.sqrt(value[keep])
        # clean examples: the most frequent words at first, then those that the machine takes for toxic
        words = likely + negative
        target = np.where(np.arange(len(words)) < len(likely), 1.0, -1.0)
        weight = np.where(target > 0, 0.5 / len(likely), 0.5 / len(negative)) * 100
        v, bias = _svm(basis.values(words) @ root, target, weight)
        model = Model(basis.weighted(root @ v), bias)
        # several instances to a label: a typical word that looks clean no longer stands for its documents
        margin = model.margins(likely)
        likely = [w for w, m in zip(likely, margin, strict=True) if m > -1] or likely
        scores = model.margins(clean)
        taken, worst = set(negative), [clean[i] for i in np.argsort(-scores, kind="stable")[:JOINING]]
        negative = negative + [w for w in worst if w not in taken]
        hard = list(dict.fromkeys(worst[:MARKING] + hard))[: landmarks * 3 // 8]
        marks = list(dict.fromkeys(likely[: landmarks // 2] + hard + spread))[:landmarks]
    del basis
    vocabulary = sorted(set().union(*docs))
    table = dict(zip(vocabulary, model.margins(vocabulary).tolist(), strict=True))
    worst = np.array([max((table[w] for w in d), default=model.empty) for d in docs])
    # logistic function of a document's worst word, fitted by Newton steps with a little shrinkage
    beta, z = np.array([1.0, 0.0]), np.stack([worst, np.ones(len(worst))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(hessian, z.T @ (y - p) - 0.01 * beta), -1, 1)
    model.slope, model.offset = max(float(beta[0]), 1e-3), float(beta[1])
    return model


def held_out(doc_id: object) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from the labelled rows that are not held out; ``sample`` bounds them."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    # by hash of the id; chosen before any text is read
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = known.where("toxic = 1").orderBy(*order).limit(sample // 3).union(known.where("toxic = 0").orderBy(*order).limit(sample - sample // 3))
    text = whole_text()
    chosen = docs.select("doc_id", F.xxhash64(text).alias("hash"), text.alias("text")).join(F.broadcast(some), "doc_id")
    worded = map_texts(chosen, ["doc_id", "hash", "toxic"], "words string", lambda: lambda texts: {"words": pa.array([" ".join(instances(t)) for t in texts], pa.string())})
    rows = materialize(worded.groupBy("doc_id", "toxic").agg(F.min_by("words", "hash").alias("words")), "training")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared: dict[str, str] = {}  # one string a word, not one an occurrence
        found = []
        for batch in batches:
            for doc_id, toxic, words in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "toxic", "words")), strict=True):
                found.append((doc_id, int(toxic > 0), [shared.setdefault(w, w) for w in words.split()]))
        found.sort(key=lambda x: x[0])
        model = train_words([w for *_, w in found], [y for _, y, _ in found])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # one task trains on the ``sample`` rows, so that the driver holds the model alone
    trained = rows.coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(trained["model"]) if trained else None


class Scorer:
    """Scores of texts, with a table of margins for one task."""

    def __init__(self, model: Model | None):
        self.model, self.known, self.size = model, {}, 0

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.model is None:
            return np.zeros(len(texts))
        found = [runs(t) for t in texts]
        if self.size > TABLE_BYTES:
            self.known, self.size = {}, 0
        new = sorted(set().union(*found).difference(self.known))
        for a in range(0, len(new), 20_000):
            part = new[a : a + 20_000]
            self.known.update(zip(part, self.model.run_margins(part).tolist(), strict=True))
        self.size += sum(map(len, new)) + ENTRY_BYTES * len(new)
        return self.model.probability(np.array([max(map(self.known.__getitem__, d), default=self.model.empty) for d in found]))


def _score(rows: DataFrame, kept: list[str], model: Model | None) -> DataFrame:
    """The kept columns of ``rows`` with the score of ``text``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[list[str]], dict[str, pa.Array]]:
        scorer = Scorer(shared.value)
        return lambda texts: {"score": pa.array(scorer(texts), pa.float64())}

    return map_texts(rows, kept, "score double", make)


def scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(docs, labels, sample)
    out = _score(docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")), ["doc_id"], model)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the documents scored 0.5 or more."""
    model = fit(docs, labels, sample)
    aside = SetAside.of(docs)
    return aside.back(_score(aside.rows, ["row", "text"], model).where("score < 0.5"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
