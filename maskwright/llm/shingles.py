"""Word shingles of UTF-8 texts as sets of 64-bit hashes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RNG = np.random.default_rng(20240229)
_LETTER = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTER[65:91] = _LETTER[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}

#: Bytes of text that are hashed at a time (a longer text goes alone).
CHUNK_BYTES = 1 << 20


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, 1 << 20) + 1
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size > 1 << 24:
            return have
        _powers[kind] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words ([^\\x20\\x09-\\x0D]+ after lower-casing A-Z), and where each text's begin (one more entry ends the last)."""
    joined = b" ".join(texts) + b" "
    raw = np.frombuffer(joined, np.uint8)
    word = ~_SPACE[raw]
    edge = np.diff(word.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.append(np.uint64(0), np.cumsum(_LETTER[raw] * _power("up", _STEP, len(raw))[: len(raw)], dtype=np.uint64))
    h = (sums[ends] - sums[starts]) * _power("down", _BACK, len(raw))[starts]
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    return mix(h), np.searchsorted(starts, begins)


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Each text's set of shingles as a sorted array of hashes: `words` consecutive words, or the whole sequence of a shorter text; empty without words."""
    h, at = word_hashes(texts)
    long_ = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for j in range(words if len(long_) else 0):
        long_ += h[j : j + len(long_)] * _PLACE[j]
    long_ = mix(long_)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= words:
            s = np.sort(long_[a : b - words + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:
            out.append(mix((h[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def in_chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > limit:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)
