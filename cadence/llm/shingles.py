"""Word shingles of many texts at once, as 64-bit hashes.

A-Z are lower-cased; words are runs of bytes other than space and 0x09 to 0x0D. Texts are
put behind one another, and hashes of words, shingles and whole word sequences are taken
from running sums over all of them, so the cost is a few array operations per byte.

A hash collision would make two shingles one; with 64 bits that is one pair in 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
_CHUNK = 1 << 18
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else 32 if 9 <= b <= 13 else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20240601).integers(0, 2**64, 256, dtype=np.uint64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    return _POWERS


def _ranges(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[s:e] for each s, e; it doesn't depend on s."""
    up, down = _powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], out=total[1:])
    return spread((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def _chunk(texts: list[bytes], words: int) -> Iterator[tuple[int, int, np.ndarray]]:
    data = np.frombuffer(b" ".join(texts).translate(_LOWER) + b" ", np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    first_byte = np.concatenate(([0], np.cumsum(size + 1)))
    inside = np.concatenate(([0], (data != 32).view(np.int8)))
    turn = np.diff(inside)
    start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    word = _ranges(_BYTE[data], start, end)
    first = np.searchsorted(start, first_byte)
    whole = _ranges(word, first[:-1], first[1:])
    base = np.uint64(_BASE)
    run = word[:max(0, len(word) - words + 1)].copy()
    for k in range(1, words):
        run = run * base + word[k:len(word) - words + 1 + k]
    run = spread(run)
    for k in range(len(texts)):
        a, b = int(first[k]), int(first[k + 1])
        if b - a >= words:
            yield int(whole[k]), b - a, np.unique(run[a:b - words + 1])
        else:
            yield int(whole[k]), b - a, whole[k:k + 1] if b > a else np.empty(0, np.uint64)


def shingle_sets(texts: list[str | None], words: int = WORDS) -> Iterator[tuple[int, int, np.ndarray]]:
    """For each text: hash of its word sequence, number of words, sorted distinct shingle hashes.

    With fewer than ``words`` words the whole sequence is the only shingle; null or empty text has none.
    """
    part: list[bytes] = []
    held = 0
    for t in texts:
        part.append((t or "").encode())
        held += len(part[-1])
        if held >= _CHUNK:
            yield from _chunk(part, words)
            part, held = [], 0
    if part:
        yield from _chunk(part, words)
