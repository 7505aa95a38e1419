"""Words and word n-grams of texts as 64-bit numbers, without a Python loop over words.

A word is a run of bytes other than ASCII white space. Its hash is a polynomial over random values of its bytes,
taken from one running sum over the text; an n-gram's hash is the same over its words' hashes. All sums wrap at
64 bits; the multiplier is odd, so that positions can be divided out again.
"""

from __future__ import annotations

import numpy as np

from .common import PIECE, pieces, worker_store

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MULTIPLIER = {1: 0x9E3779B97F4A7C15, 2: 0xC2B2AE3D27D4EB4F}


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit may change every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _byte_values(seed: int) -> np.ndarray:
    kept = worker_store("words")
    if seed not in kept:
        kept[seed] = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER[seed]) + np.uint64(seed))
    return kept[seed]


def _kept_powers(seed: int) -> tuple[np.ndarray, np.ndarray]:
    kept = worker_store("tables")
    if seed not in kept:
        kept[seed] = _make_powers(seed, 2 * PIECE)
    return kept[seed]


def _make_powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_MULTIPLIER[seed], pow(_MULTIPLIER[seed], -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[:1] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _kept_powers(seed) if n <= 2 * PIECE else _make_powers(seed, n)
    return up[:n], down[:n]


def run_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """Hashes of runs of values, from ``start`` to before ``end``."""
    up, down = _powers(seed, len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up, out=total[1:])
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(texts: list[bytes], seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of some texts, and where each text's words begin (one more entry for the end)."""
    found, counts = [], np.zeros(len(texts), np.int64)
    group, size, first = [], 0, 0
    for i, t in enumerate([*texts, None]):
        if t is None or size + len(t) > PIECE:
            if group:
                h, n = _hash_group(group, seed)
                found.append(h)
                counts[first : first + len(group)] = n
            group, size, first = [], 0, i
            if t is not None and len(t) > PIECE:
                for p in pieces(t):
                    h, n = _hash_group([p], seed)
                    found.append(h)
                    counts[i] += n[0]
                first = i + 1
                continue
        if t is not None:
            group.append(t)
            size += len(t) + 1
    return np.concatenate(found) if found else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])


def _hash_group(texts: list[bytes], seed: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    at = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.concatenate([[0], np.searchsorted(start, at)]))
    if not len(start):
        return np.zeros(0, np.uint64), counts
    return run_hashes(_byte_values(seed)[data], start, end, seed), counts


def ngrams(words: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """Hashes of all runs of ``n`` words of one sequence (none if it is shorter)."""
    k = len(words) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64)
    start = np.arange(k)
    return run_hashes(words, start, start + n, seed)


def shingle_sets(texts: list[bytes], n: int = 5) -> list[np.ndarray]:
    """The sorted set of ``n``-word shingles of each text, A-Z in lower case; fewer words are one shingle, none give none."""
    h, at = word_hashes([t.translate(LOWER) for t in texts])
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        k = min(n, b - a)
        out.append(np.unique(ngrams(h[a:b], k)) if k else np.zeros(0, np.uint64))
    return out
