"""Vectorised word and word-run hashes over batches of UTF-8 texts.

Hashes are polynomials modulo 2**64 with an odd base, taken from prefix sums; the base's inverse makes them independent
of the place.  They are equal in every process, and depend on the words alone.
"""

from __future__ import annotations

import numpy as np

BASE, RUN_BASE, OTHER_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5
#: Bytes of text that are hashed at once.
BLOCK = 1 << 20


def _separators(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: Space and the controls 9 to 13; and these with the rest of ASCII that is neither a letter nor a digit.
WHITE = _separators(b" \t\n\x0b\x0c\r")
PUNCTUATION = _separators(bytes(c for c in range(128) if not chr(c).isalnum()))

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i below n at least."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, 1 << 16)
        _powers[base] = tuple(np.concatenate([np.ones(1, "u8"), np.cumprod(np.full(size - 1, b, "u8"))]) for b in (base, pow(base, -1, 1 << 64)))
    return _powers[base]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _block(data: bytes, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``data``, which ends with a separator, and their starts."""
    raw = np.frombuffer(data, "u1")
    word = ~separators[raw]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    up, down = powers(BASE, len(raw) + 1)
    total = np.concatenate([np.zeros(1, "u8"), np.cumsum((raw.astype("u8") + np.uint64(1)) * up[: len(raw)])])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype("u8")), starts


def word_hashes(texts: list[bytes], separators: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the number of words before it (one more entry at the end)."""
    hashes, counts = [], np.zeros(len(texts) + 1, "i8")
    i = 0
    while i < len(texts):
        j, size = i + 1, len(texts[i])
        while j < len(texts) and size + len(texts[j]) <= BLOCK:
            size += len(texts[j])
            j += 1
        if size <= 2 * BLOCK:
            found, starts = _block(b"\n".join(texts[i:j]) + b"\n", separators)
            ends = np.cumsum([len(t) + 1 for t in texts[i:j]])
            hashes.append(found)
            counts[i + 1 : j + 1] = np.diff(np.searchsorted(starts, ends), prepend=0)
        else:  # one long text, in blocks that end between words
            text, at = texts[i], 0
            while at < len(text):
                stop = min(len(text), at + BLOCK)
                while stop < len(text) and not separators[text[stop]]:
                    stop += 1
                found, _ = _block(text[at:stop] + b"\n", separators)
                hashes.append(found)
                counts[i + 1] += len(found)
                at = stop
        i = j
    return np.concatenate(hashes) if hashes else np.zeros(0, "u8"), np.cumsum(counts)


def run_hashes(words: np.ndarray, k: int, base: int = RUN_BASE) -> np.ndarray:
    """Hash of each run of k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, "u8")
    up, down = powers(base, len(words) + 1)
    total = np.concatenate([np.zeros(1, "u8"), np.cumsum(words * up[: len(words)])])
    return mix((total[k:] - total[:-k]) * down[:n])
