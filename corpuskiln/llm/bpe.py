"""Operator 8: BPE encoding and decoding.

``Bpe`` reads a tokenizer file of the word-end BPE kind (NFC, white space to one space, lower case; split into
contractions, letter runs, single digits and other runs; byte alphabet; merges; a suffix marks a word's end) and
gives the ids that the tokenizers library gives.  A word is encoded with a priority queue of merge ranks over a
doubly linked symbol list: each pop merges the lowest-ranked adjacent pair, leftmost first; entries whose symbols have
changed meanwhile are stale and skipped.  Words repeat, so each is encoded once a batch at most: a batch's runs are
numbered by Arrow, the distinct ones split into words, the words looked up in tables bounded in bytes (kept by a worker
from one encoding task to the next, given up before work of another kind), and ids go back to texts by these numbers.

Defined results: null and empty texts give no ids, the digest of no bytes and the digest of the empty string; text of
white space alone gives no ids; special tokens' strings in a text become their ids, as in the library; very long texts
are encoded whole, run by run; repeated rows give repeated results; ids of any size and null ids come back as they are;
other columns, whatever their names, are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HELD, map_texts, quoted, whole_text

#: Unicode's White_Space property, written out as the library's regular expressions take it.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Bytes that each of a worker's two tables of encoded words, the newer and the older, may take.
TABLE_BYTES = 96_000_000
#: Words of more bytes than this go through the queue, whatever else is encoded at once.
LONG_WORD = 64
#: The rank of a pair that doesn't merge.
NEVER = 1 << 30
#: Bytes of texts that are encoded together.
BATCH_BYTES = 8_000_000
#: What an entry takes beside its characters and ids: two objects' heads, the hash slot.
ENTRY_BYTES = 190


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> list[str]:
    """The printable stand-in for each byte: itself where printable Latin-1, else 256 and up in byte order."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(others)) for b in range(256)]


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.ranks: dict[int, int] = {}  # left << 32 | right: rank
        self.left, self.right, self.made = [], [], []  # by rank
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y = self.vocab[a], self.vocab[b]
            self.ranks[x << 32 | y] = rank
            for column, value in ((self.left, x), (self.right, y), (self.made, self.vocab[a + b])):
                column.append(value)
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = [""] * (1 + max([*self.vocab.values(), *added.values()]))
        for token, i in (self.vocab | added).items():
            self.strings[i] = token
        self.special = {k: array("I", [v]).tobytes() for k, v in added.items()}
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        words = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
        self.split = regex.compile(words).findall
        self.split_lines = regex.compile(words + r"|\n").findall
        # Texts with special tokens, or with four controls that Arrow and Python, unlike the library, take for white space.
        self.odd = "|".join([r"[\x1c-\x1f]", *(re.escape(x) for x in added)])
        alphabet = byte_alphabet()
        self.inner, self.last = ([self.vocab.get(c + end, -1) for c in alphabet] for end in ("", self.suffix))
        keys = np.array([*self.ranks, (1 << 64) - 1], "u8")
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([*self.ranks.values(), NEVER])[order]
        self.forget()

    def forget(self) -> None:
        """Give up all tables."""
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.known_bytes = 0

    def normalize(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # sigma: per character, whatever follows
        return text.lower()  # white space only separates words, so runs of it need no rewriting

    def word(self, word: str) -> list[int]:
        """Ids of one word: lowest rank first from a queue, stale entries skipped."""
        ranks, left, right, made = self.ranks, self.left, self.right, self.made
        symbols = word.encode("utf-8")
        ids = [*map(self.inner.__getitem__, symbols[:-1]), self.last[symbols[-1]]]
        if -1 in ids:
            ids = [x for x in ids if x >= 0]
        n = len(ids)
        queue = []  # rank * n + place of the left symbol
        for i in range(n - 1):
            if (rank := ranks.get(ids[i] << 32 | ids[i + 1])) is not None:
                queue.append(rank * n + i)
        if not queue:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapify(queue)
        while queue:
            rank, i = divmod(heappop(queue), n)
            j = after[i]
            if ids[i] != left[rank] or j >= n or ids[j] != right[rank]:
                continue  # stale
            ids[i] = new = made[rank]
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (rank := ranks.get(new << 32 | ids[k])) is not None:
                    heappush(queue, rank * n + i)
            if (h := before[i]) >= 0 and (rank := ranks.get(ids[h] << 32 | new)) is not None:
                heappush(queue, rank * n + h)
        return [x for x in ids if x >= 0]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype("u8") << np.uint64(32) | right.astype("u8")
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)

    def _one_length(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of words of one length: the linked lists of all as arrays, and in each round every word's next merge."""
        n = len(words[0])
        symbols = np.frombuffer(b"".join(words), "u1").reshape(-1, n)
        ids = np.array(self.inner)[symbols]
        ids[:, -1] = np.array(self.last)[symbols[:, -1]]
        made = np.array(self.made)
        ranks = np.full(ids.shape, NEVER)
        ranks[:, :-1] = self._rank(ids[:, :-1], ids[:, 1:])
        after, before = (np.tile(np.arange(n) + step, (len(words), 1)) for step in (1, -1))
        live = np.arange(len(words))
        while live.size:
            open_ranks = ranks[live]
            i = open_ranks.argmin(axis=1)  # the lowest rank, leftmost first
            rank = np.take_along_axis(open_ranks, i[:, None], axis=1)[:, 0]
            go = rank < NEVER
            live, i, new = live[go], i[go], made[rank[go]]
            j = after[live, i]
            k = after[live, j]
            h = before[live, i]
            ids[live, i], ids[live, j], after[live, i] = new, -1, k
            ranks[live, i] = ranks[live, j] = NEVER
            on = k < n
            row, at, to = live[on], i[on], k[on]
            before[row, to] = at
            ranks[row, at] = self._rank(new[on], ids[row, to])
            on = h >= 0
            row, at = live[on], h[on]
            ranks[row, at] = self._rank(ids[row, at], new[on])
        left = ids >= 0
        ends = 4 * np.cumsum([0, *left.sum(axis=1)])
        raw = ids[left].astype("<u4").tobytes()
        return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def at_once(self, words: list[str]) -> list[bytes]:
        """What ``word`` gives for each of many words, packed."""
        symbols = [w.encode("utf-8") for w in words]
        out = [b""] * len(words)
        lengths = np.array([len(x) for x in symbols], dtype="i8")
        for n in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == n).tolist()
            slow = n > LONG_WORD or -1 in self.inner or -1 in self.last
            found = [array("I", self.word(words[r])).tobytes() for r in rows] if slow else self._one_length([symbols[r] for r in rows])
            for r, ids in zip(rows, found, strict=True):
                out[r] = ids
        return out

    def packed(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if self.cut_special is None or "<" not in text:
            return self._plain(text)
        return b"".join(self.special[part] if k % 2 else self._plain(part) for k, part in enumerate(self.cut_special.split(text)))

    def _plain(self, text: str) -> bytes:
        return b"".join(self._words(self.split(self.normalize(text)), False))

    def _words(self, words: list[str], at_once: bool) -> list[bytes]:
        """Packed ids of each word, from the tables or new: one by one through the queue, or all together."""
        for word in words:
            if word not in self.known and (ids := self.older.get(word)) is not None:
                self._keep(word, ids)
        known = self.known
        new = list(set(words).difference(known))
        fresh = dict(zip(new, self.at_once(new) if at_once else [array("I", self.word(w)).tobytes() for w in new], strict=True))
        out = [known[w] if w in known else fresh[w] for w in words]
        for word, ids in fresh.items():
            self._keep(word, ids)
        return out

    def _keep(self, word: str, ids: bytes) -> None:
        self.known[word] = ids
        self.known_bytes += ENTRY_BYTES + 4 * len(word) + len(ids)

    def _turn(self) -> None:
        """The newer table becomes the older once it is full."""
        if self.known_bytes > TABLE_BYTES:
            self.older, self.known, self.known_bytes = self.known, {}, 0

    def _runs(self, runs: list[str], at_once: bool) -> pa.ListArray:
        """Ids of each run of non-space characters; no token crosses white space, so the runs are split as lines of one text."""
        parts = pa.array(self.split_lines(self.normalize("\n".join(runs))), pa.string()).dictionary_encode()
        words = parts.dictionary.to_pylist()
        line = words.index("\n") if "\n" in words else -1
        if line >= 0:
            words[line] = ""
        found = self._words([w for w in words if w], at_once)
        if line >= 0:
            found.insert(line, b"")
        ids = _lists(found).take(parts.indices)
        at = ids.offsets.to_numpy()
        ends = at[:-1][parts.indices.to_numpy() == line]
        return pa.ListArray.from_arrays(pa.array(np.concatenate([at[:1], ends, at[-1:]])), ids.values)

    def packed_all(self, texts: list[str], at_once: bool = False) -> list[bytes]:
        """``packed`` of each text, with runs that repeat encoded once; ``at_once`` merges all new words' symbols together."""
        self._turn()
        column = pa.array(texts, pa.string())
        odd = pc.match_substring_regex(column, self.odd)
        rows = pc.utf8_split_whitespace(pc.if_else(odd, "", column))
        if not len(rows.values):
            return []
        runs = rows.values.dictionary_encode()
        ids = self._runs(runs.dictionary.to_pylist(), at_once).take(runs.indices)
        ends = 4 * ids.offsets.to_numpy().astype("i8")[rows.offsets.to_numpy()]
        raw = memoryview(ids.values.to_numpy()).cast("B")
        out = [bytes(raw[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self.packed(texts[i])
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings in order; the file names no decoder, so the library puts a space between them."""
        return " ".join(map(self.strings.__getitem__, ids))


def _lists(packed: list[bytes]) -> pa.ListArray:
    """Packed ids as an array of lists."""
    ends = np.cumsum([0, *[len(p) // 4 for p in packed]], dtype="i4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<u4")))


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """One ``Bpe`` a worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


class Work:
    """A function of a batch's texts; the tokenizer's tables stay for the next task of this kind."""

    def __init__(self, path: str, derive: Callable[[Bpe, list[str]], dict[str, pa.Array]]):
        self.bpe, self.derive, self.holds = load(path), derive, f"bpe {path}"
        HELD[self.holds] = self.bpe.forget

    def __call__(self, texts: list[str]) -> dict[str, pa.Array]:
        return self.derive(self.bpe, texts)


def _ids(bpe: Bpe, texts: list[str]) -> dict[str, pa.Array]:
    return {"ids": _lists(bpe.packed_all(texts)).cast(pa.list_(pa.int64()))}


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ids (array of long) of each whole text."""
    path = path or default_path()
    rows = docs.select(quoted(id_col).alias("id"), whole_text(text_col).alias("text"))
    return map_texts(rows, ["id"], "ids array<bigint>", lambda: Work(path, _ids), BATCH_BYTES).withColumnRenamed("id", id_col)


def decode_ids(df: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col``, text: the vocabulary strings of ``ids_col``; null ids give the empty string."""
    path = path or default_path()
    rows = df.select(quoted(id_col).alias("id"), F.coalesce(quoted(ids_col), F.array().cast("array<bigint>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = [bpe.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def _digests(bpe: Bpe, texts: list[str]) -> dict[str, pa.Array]:
    counts, ids_sha, text_sha = [], [], []
    for packed in bpe.packed_all(texts):
        counts.append(len(packed) // 4)
        ids_sha.append(hashlib.sha256(packed).hexdigest())
        text_sha.append(hashlib.sha256(bpe.decode(np.frombuffer(packed, "<u4").tolist()).encode()).hexdigest())
    return {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode each text, decode its ids, and return the digests of both (see the module for edge cases)."""
    path = path or default_path()
    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return map_texts(rows, ["doc_id"], "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda: Work(path, _digests), BATCH_BYTES)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
