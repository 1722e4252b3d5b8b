"""Word-shingle sets of whole texts, computed over bytes of many texts at once."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_generator = np.random.default_rng(20240611)
_LETTER = _generator.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = _generator.integers(1, 1 << 63, 8, dtype=np.uint64) | _U(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Powers that a worker keeps between batches; for longer texts they are made anew.
_KEPT_POWERS = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        tables = []
        for base in (_BASE, _INVERSE):
            table = np.full(max(n, min(2 * n, _KEPT_POWERS)), base, np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        if n > _KEPT_POWERS:
            return tables[0], tables[1]
        _powers[:] = tables
    return _powers[0], _powers[1]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words ([^\\x20\\x09-\\x0D]+, A-Z lower-cased) in order, and the number of words of each text."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    space = _SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    up, down = _power(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[data] * up[: len(data)], dtype=np.uint64)])
    words = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    bounds = np.cumsum([1, *(len(r) + 1 for r in raw)])
    return words, np.diff(np.searchsorted(starts, bounds))


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's ``size``-word shingles; of a text with fewer words, the whole as one; none without words."""
    words, counts = word_hashes(texts)
    rolled = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        rolled += words[k : len(words) - size + 1 + k] * _PLACE[k]
    rolled = mix(rolled)
    out, at = [], 0
    for n in counts.tolist():
        if n >= size:
            out.append(np.unique(rolled[at : at + n - size + 1]))
        elif n:
            out.append(mix((words[at : at + n] * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True) + _U(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out
