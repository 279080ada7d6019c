"""Hashed word and character n-gram counts of UTF-8 texts, in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from maskwright.llm.shingles import _BACK, _LETTER, _SPACE, _STEP, _power, mix

#: Lengths of character n-grams; a word's edge counts as a character.
GRAMS = (3, 4, 5)
#: Bytes of text that are hashed at a time; each takes about 150 bytes meanwhile.
PART = 1 << 18
_LAST_SPACE = re.compile(rb"[\t-\r ]")
REPEAT = np.uint64(0x5851F42D4C957F2D)
_EXACT = np.where(_SPACE, np.uint64(1), mix(np.arange(1, 257, dtype=np.uint64)))
_FOLDED = np.where(_SPACE, np.uint64(1), _LETTER)


def subword_buckets(texts: list[bytes], buckets: int, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every word, repetition and n-gram of all texts, and the number of the text that each is of. fold: A-Z count as a-z."""
    joined = b" " + b"  ".join(texts) + b"    "
    raw = np.frombuffer(joined, np.uint8)
    space = _SPACE[raw]
    letter = (_FOLDED if fold else _EXACT)[raw]
    sums = np.append(np.uint64(0), np.cumsum(letter * _power("up", _STEP, len(raw))[: len(raw)], dtype=np.uint64))
    back = _power("down", _BACK, len(raw))
    begins = np.cumsum([0] + [len(t) + 2 for t in texts])
    edge = np.diff((~space).astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    words = mix((sums[ends] - sums[starts]) * back[starts])
    # a word that repeats the one before it counts, whatever it is, as one more feature
    again = starts[1:][words[1:] == words[:-1]]
    found = [(words, starts), (np.full(len(again), REPEAT), again)]
    gaps = np.append(0, np.cumsum(space))
    for n in GRAMS:
        # a window may hold white space at its ends alone
        at = np.flatnonzero(gaps[n - 1 : len(raw)] == gaps[1 : len(raw) - n + 2])
        at = at[at + n <= len(raw)]
        found.append((mix((sums[at + n] - sums[at]) * back[at] + np.uint64(n)), at))
    bucket = np.concatenate([h for h, _ in found]) & np.uint64(buckets - 1)
    place = np.concatenate([p for _, p in found])
    return bucket.astype(np.int64), np.searchsorted(begins, place + 1, side="right") - 1


def cut_texts(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """The texts in groups of about PART bytes, with the number of the text that each part is of. Longer texts are cut at white space where there is some (a repetition across a cut doesn't count), so memory follows PART, not the longest text."""
    own, held, size = [], [], 0
    for k, t in enumerate(texts):
        at = 0
        while True:
            end = len(t)
            if end - at > PART:
                spaces = [m.start() for m in _LAST_SPACE.finditer(t, at + PART // 2, at + PART)][-1:]
                end = spaces[0] if spaces else at + PART
            if held and size + end - at > PART:
                yield own, held
                own, held, size = [], [], 0
            own.append(k)
            held.append(t[at:end])
            size += end - at
            at = end
            if at >= len(t):
                break
    if held:
        yield own, held


def subword_counts(texts: list[bytes], buckets: int, fold: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of each text."""
    parts: list[list] = [[] for _ in texts]
    for own, part in cut_texts(texts):
        bucket, at = subword_buckets(part, buckets, fold)
        key, n = np.unique(at * buckets + bucket, return_counts=True)
        cut = np.searchsorted(key, np.arange(len(part) + 1) * buckets)
        for k, a, b in zip(own, cut[:-1], cut[1:], strict=True):
            parts[k].append(((key[a:b] % buckets).astype(np.int32), n[a:b].astype(np.float32)))
    return [p[0] if len(p) == 1 else _added(p) for p in parts]


def _added(parts: list) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return key, np.bincount(at, np.concatenate([n for _, n in parts]), len(key)).astype(np.float32)
