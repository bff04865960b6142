"""Operator 2: secret scan behind a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived (``trigram_query``): every match must
contain the trigrams that the query names.  Texts are indexed in segments, as search engines do: one pass over all
trigrams of a segment of some megabytes fills a posting list for each trigram that any rule names; these are
intersected and united as the query says, and only the candidate rows are verified with the regular expression.  A rule without mandatory trigrams scans its segment fully.
Segments are local to a task, so nothing is shuffled and memory is bounded by the segment.  ``build_index`` and
``candidates`` give the same index as a table, split into segments so that no posting list grows without bound, for
rules that come later.

The index folds the case of ASCII letters (a superset of what a case-sensitive rule can match, so no match is lost).
Every pattern takes time linear in the text, whatever it holds: no rule starts anew inside a run that it has searched.

Defined results: null and empty texts have no spans; very long texts are scanned whole; repeated rows give repeated
results; spans are in code points, end exclusive, ordered by start, ties by kind as listed; null ids and ids of any
size come back as they are; other columns, whatever their names, pass through ``redact`` unchanged (``n_chars``
follows the text) and are ignored by ``scan``; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SetAside, map_texts, whole_text


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds; ``least`` is the length that ``group`` must have (shorter matches are dropped)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The three base rules, in the order in which ties are listed.
BASE_RULES = (
    Rule("assign", r"(?ai:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Further credentials, each with mandatory trigrams.
MORE_RULES = (
    # with the lines of its body, where they follow, and its end mark
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:\s*[A-Za-z0-9+/=]{16,})*+(?:\s*[A-Za-z0-9+/=]{1,15}(?=\s*-----END))?(?:\s*-----END [A-Z ]{0,40}PRIVATE KEY-----)?"),
    Rule("bearer", r"(?ai:bearer)\x20++[A-Za-z0-9._~+/-]{20,}+=*"),
    Rule("signed_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("url_login", r"[a-z]{2,12}://[^\s:/@]{1,64}:[^\s:/@]{3,64}@"),
)
RULES = BASE_RULES + MORE_RULES

#: A query is True (no mandatory trigram), a trigram, ("and", parts) or ("or", parts).
Query = object
EXACT_MOST = 64


def _all(parts: list[Query]) -> Query:
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    return True if not parts or True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[str]) -> Query:
    """What holds of a text that contains one of the strings."""
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query that every match of ``pattern`` fulfils, case folded."""

    def sequence(items: object) -> tuple[set[str] | None, Query]:
        """The exact strings matched, where few, else None; and the query."""
        run, parts = {""}, []
        whole = True
        for op, arg in items:
            exact, query = node(op, arg)
            if exact is not None and len(run) * len(exact) <= EXACT_MOST:
                run = {a + b for a in run for b in exact}
                continue
            parts += [_of_strings(run), query]
            run, whole = exact if exact is not None else {""}, False
        if whole:
            return run, _of_strings(run)
        return None, _all([*parts, _of_strings(run)])

    def node(op: object, arg: object) -> tuple[set[str] | None, Query]:
        if op is C.LITERAL:  # what isn't ASCII has more cases than the index folds
            return ({chr(arg).lower()}, True) if arg < 128 else (None, True)
        if op is C.IN:
            values: set[str] = set()
            for kind, x in arg:
                if kind is C.LITERAL and x < 128:
                    values.add(chr(x).lower())
                elif kind is C.RANGE and x[1] < 128 and x[1] - x[0] < EXACT_MOST:
                    values |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    return None, True
            return (values, True) if len(values) <= 8 else (None, True)
        if op is C.SUBPATTERN:
            return sequence(arg[3])
        if op is C.BRANCH:
            found = [sequence(x) for x in arg[1]]
            if all(e is not None for e, _ in found) and sum(len(e) for e, _ in found) <= EXACT_MOST:
                return set().union(*(e for e, _ in found)), _any([q for _, q in found])
            return None, _any([q for _, q in found])
        if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, inner = arg
            exact, query = sequence(inner)
            if exact is not None and (low, high) == (0, 1):
                return exact | {""}, True
            if exact is not None and len(exact) == 1 and low == high <= EXACT_MOST:
                return {next(iter(exact)) * low}, True
            return None, query if low else True
        if op is C.AT or op in (C.ASSERT, C.ASSERT_NOT):
            return {""}, True
        if op is C.ATOMIC_GROUP:
            return sequence(arg)
        return None, True

    return sequence(parser.parse(pattern))[1]


def trigrams_of(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


def evaluate(query: Query, postings: dict[str, set[int]], rows: set[int]) -> set[int]:
    """Rows that fulfil the query, by intersecting and uniting postings."""
    if query is True:
        return rows
    if isinstance(query, str):
        return postings.get(query, set())
    parts = [evaluate(q, postings, rows) for q in query[1]]
    return set.intersection(*sorted(parts, key=len)) if query[0] == "and" else set().union(*parts)


class Scanner:
    """Rules with their queries; trigrams of bytes, case folded, as numbers below 2**24."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = [(i, r, re.compile(r.pattern), trigram_query(r.pattern)) for i, r in enumerate(rules)]
        self.grams = {g: int.from_bytes(g.encode(), "big") for g in sorted(set().union(*(trigrams_of(q) for *_, q in self.rules)))}
        self.named = np.zeros(1 << 24, bool)
        self.named[list(self.grams.values())] = True

    def segment(self, texts: list[str]) -> dict[str, set[int]]:
        """The segment's postings, trigram to rows, from one pass over its trigrams."""
        folded = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        ends = np.cumsum([len(f) + 1 for f in folded])
        raw = np.frombuffer(b"\0".join(folded) + b"\0", "u1").astype("i4")
        codes = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
        at = np.flatnonzero(self.named[codes])
        found = np.unique(codes[at].astype("i8") << 32 | np.searchsorted(ends, at, side="right"))
        gram, row = found >> 32, found & 0xFFFFFFFF
        lists = {g: set(row[np.searchsorted(gram, g) : np.searchsorted(gram, g, side="right")].tolist()) for g in np.unique(gram).tolist()}
        return {g: lists.get(code, set()) for g, code in self.grams.items()}

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text (start, rule number, end), in order."""
        postings, rows = self.segment(texts), set(range(len(texts)))
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for number, rule, pattern, query in self.rules:
            group, least = rule.group, rule.least
            for i in evaluate(query, postings, rows):
                for m in pattern.finditer(texts[i]):
                    if m.end(group) - m.start(group) >= least:
                        found[i].append((m.start(), number, m.end()))
        for spans in found:
            spans.sort()
        return found


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segments: int = 64, grams: list[str] | None = None) -> DataFrame:
    """segment, gram, ids: the inverted index as a table; ``grams`` limits it to those that rules name."""
    text = F.lower(whole_text(text_col))
    base = docs.select(F.col(id_col).alias("id"), F.pmod(F.xxhash64(id_col), F.lit(segments)).alias("segment"), text.alias("text"))
    if grams is not None:
        inside = F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(F.col("text"), g))
    else:
        inside = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text") - 2), lambda i: F.substring(F.col("text"), i, F.lit(3))))
        base = base.where(F.length("text") >= 3)
    return base.select("segment", "id", F.explode(inside).alias("gram")).groupBy("segment", "gram").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def candidates(index: DataFrame, pattern: str) -> DataFrame | None:
    """segment, id: what may match ``pattern``; None if it has no mandatory trigram and all must be scanned."""

    def of(query: Query) -> DataFrame:
        if isinstance(query, str):
            return index.where(F.col("gram") == query).select("segment", "ids")
        out = of(query[1][0])
        for part in query[1][1:]:
            other = of(part).withColumnRenamed("ids", "_ids")
            if query[0] == "and":
                out = out.join(other, "segment").select("segment", F.array_intersect("ids", "_ids").alias("ids"))
            else:
                none = F.array().cast(index.schema["ids"].dataType)
                out = out.join(other, "segment", "full").select("segment", F.array_union(F.coalesce("ids", none), F.coalesce("_ids", none)).alias("ids"))
        return out

    query = trigram_query(pattern)
    return None if query is True else of(query).select("segment", F.explode("ids").alias("id"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, found: array of (kind, start, end), in order, for each document."""

    def make() -> Callable[[list[str]], dict[str, pa.Array]]:
        scanner = Scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return lambda texts: {"found": pa.array([[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in s] for s in scanner.spans(texts)], kind)}

    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return map_texts(rows, ["doc_id"], "found array<struct<kind:string,start:int,end:int>>", make)


def redacted(text: str, spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    """Each span, overlapping ones united, replaced by a mark that names the kind that starts first."""
    parts, at, i = [], 0, 0
    while i < len(spans):
        start, kind, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][2])
            i += 1
        parts += [text[at:start], f"[REDACTED {rules[kind].kind}]"]
        at = end
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with each secret replaced by a mark; n_chars, where present, follows; a null text stays null."""
    aside = SetAside.of(docs)

    def make() -> Callable[[list[str]], dict[str, pa.Array]]:
        scanner = Scanner(rules)
        return lambda texts: {"new": pa.array([redacted(t, s, rules) if s else None for t, s in zip(texts, scanner.spans(texts), strict=True)], pa.string())}

    # only changed texts come back from Python
    done = map_texts(aside.rows, ["row", "text"], "new string", make)
    return aside.back(done.select("row", F.coalesce("new", "text").alias("text")), text_changed=True)


def scan_digests(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    base = len(BASE_RULES)

    def make() -> Callable[[list[str]], dict[str, pa.Array]]:
        scanner = Scanner(RULES)

        def work(texts: list[str]) -> dict[str, pa.Array]:
            counts: list[list[int]] = [[] for _ in range(base)]
            digests, written = [], []
            for spans in scanner.spans(texts):
                for k in range(base):
                    counts[k].append(sum(x[1] == k for x in spans))
                text = [(k, f"{RULES[k].kind}:{a}:{b}") for a, k, b in spans]
                digests.append(hashlib.sha256(",".join(t for k, t in text if k < base).encode()).hexdigest())
                written.append(",".join(t for _, t in text))
            out = {f"n_{r.kind}": pa.array(n, pa.int64()) for r, n in zip(BASE_RULES, counts, strict=True)}
            return out | {"base_sha256": pa.array(digests, pa.string()), "spans": pa.array(written, pa.string())}

        return work

    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return map_texts(rows, ["doc_id"], "n_assign long, n_access long, n_hex long, base_sha256 string, spans string", make)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
