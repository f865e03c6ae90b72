"""Hashes of words and of word sequences, for many texts at a time."""

from __future__ import annotations

import numpy as np

from corpusloom.llm.common import SPACES
from corpusloom.llm.suffix_dedup import RangeHash

# Bytes hashed at a time.
PART = 1 << 20
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES.encode())] = True


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of every word of all texts, and the number of words before each text and after the last."""
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    found, word_ends, at = [], [], 0
    while at < len(data):
        # A part ends behind the next space, so that it cuts no word.
        to = min(len(data), at + PART)
        while to < len(data) and not _IS_SPACE[data[to - 1]]:
            more = np.flatnonzero(_IS_SPACE[data[to : to + PART]])
            to = to + int(more[0]) + 1 if len(more) else min(len(data), to + PART)
        part = data[at:to]
        inside = ~_IS_SPACE[part]
        edge = np.flatnonzero(inside != np.r_[False, inside[:-1]])
        first, last = edge[::2], edge[1::2]
        if len(last) < len(first):
            last = np.r_[last, len(part)]
        found.append(RangeHash(part).of(first, last))
        word_ends.append(last + at)
        at = to
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    return np.concatenate(found), np.r_[0, np.searchsorted(np.concatenate(word_ends), ends, side="left")].astype(np.int64)


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out
