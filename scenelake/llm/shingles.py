"""Sets of hashed word shingles, computed for a batch of texts at once.

Words are runs of characters that are no ASCII white space, A-Z lower-cased. A
text's set holds the 64-bit hashes of its distinct runs of ``SIZE`` words; a
text of fewer words has one shingle, the whole sequence; a text without words
has none.
"""

from __future__ import annotations

import numpy as np

SIZE = 5

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 64, 256, np.uint64)
_MULT = _rng.integers(0, 1 << 63, SIZE, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(0, 1 << 63)) * 2 + 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finish that spreads all bits."""
    x = x ^ x >> np.uint64(30)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if _powers[0].size < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The set of each text as a sorted array of uint64, about 256 KB of text at a time."""
    out: list[np.ndarray] = []
    part: list[bytes] = []
    size = 0
    for text in texts:
        raw = text.encode().translate(_LOWER) if text else b""
        if part and size + len(raw) > 1 << 18:
            out += _sets(part)
            part, size = [], 0
        part.append(raw)
        size += len(raw)
    return out + (_sets(part) if part else [])


def _sets(raws: list[bytes]) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    space = _SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts = edges[space[edges - 1]] if space[0] else np.concatenate([[0], edges[space[edges - 1]]])
    ends = edges[space[edges]]
    up, down = _power(data.size)
    totals = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up, dtype=np.uint64)])
    words = mix((totals[ends] - totals[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    begins = np.cumsum([0] + [len(r) + 1 for r in raws])
    first = np.searchsorted(starts, begins)
    if words.size >= SIZE:
        n = words.size - SIZE + 1
        runs = np.zeros(n, np.uint64)
        for k in range(SIZE):
            runs += words[k : k + n] * _MULT[k]
        runs = mix(runs)
    else:
        runs = np.zeros(0, np.uint64)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= SIZE:
            out.append(np.unique(runs[a : b - SIZE + 1]))
        elif b > a:
            whole = (words[a:b] * _MULT[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([whole], np.uint64) ^ np.uint64(0x5851F42D4C957F2D)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_hash(found: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    total = mix(found + np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) + np.uint64(found.size)
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])
