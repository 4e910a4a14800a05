"""Words and shingles of UTF-8 texts as arrays of 64-bit hashes.

Words are separated by the six ASCII blanks, as bytes.split() has it.  A word's hash is a
polynomial in random byte values, taken as a difference of running sums, so the work is a
few array operations a text.  Long texts are cut at blanks and hashed piece by piece.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

PIECE = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF97
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = 0xD6E8FEB86659FD95
_BACK = pow(_STEP, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_BLANK = np.zeros(256, dtype=bool)
_BLANK[list(b" \t\n\x0b\f\r")] = True


@lru_cache(maxsize=8)
def powers(base: int, size: int) -> np.ndarray:
    """1, base, base^2 ... modulo 2^64."""
    steps = np.full(size, base, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def cover(n: int) -> int:
    """A size of at least n, of which there are few."""
    size = 4096
    while size < n:
        size *= 4
    return size


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the words start and end."""
    blank = _BLANK[np.frombuffer(data, dtype=np.uint8)]
    inside = np.empty(len(blank) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(blank, out=inside[1:-1].view(bool))
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def _hash_piece(data: bytes) -> np.ndarray:
    return _hash_spans(data, *word_spans(data))


def _hash_spans(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    size = cover(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    values = _BYTES[np.frombuffer(data, dtype=np.uint8)]
    values *= powers(_BASE, size)[: len(data)]
    np.cumsum(values, out=sums[1:])
    found = (sums[ends] - sums[starts]) * powers(_INVERSE, size)[starts]
    return mix(found + (ends - starts).astype(np.uint64) * np.uint64(_ODD))


def word_hashes(data: bytes) -> np.ndarray:
    """A hash for each word of the text, in order."""
    if len(data) <= 2 * PIECE:
        return _hash_piece(data)
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and not _BLANK[data[end]]:
            end += 1
        parts.append(_hash_piece(data[at:end]))
        at = end
    return np.concatenate(parts)


def run_hashes(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash for each run words[begin:end]: a polynomial in the words' hashes, as a difference of running sums."""
    n = len(words)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(words * powers(_STEP, cover(n + 1))[:n], out=sums[1:])
    found = (sums[end] - sums[begin]) * powers(_BACK, cover(n + 1))[begin]
    return mix(found + (end - begin).astype(np.uint64) * np.uint64(_ODD))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for each window of ``width`` words; of a shorter, non-empty text, one for all its words."""
    n = len(words)
    if n == 0:
        return words
    begin = np.arange(n - min(n, width) + 1)
    return run_hashes(words, begin, begin + min(n, width))


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, ascending."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])[: len(values)]]


def shingle_set(data: bytes, width: int) -> np.ndarray:
    """Distinct hashes of the text's shingles, ascending."""
    return distinct(window_hashes(word_hashes(data), width))


def fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit sums that name a set of hashes."""
    if not len(hashes):
        return 0, 0
    both = np.array([mix(hashes).sum(dtype=np.uint64), mix(hashes ^ np.uint64(_ODD)).sum(dtype=np.uint64)])
    return tuple(int(x) for x in both.view(np.int64))


#: Bytes of texts that are hashed together: short texts one by one would cost more in calls than in work.
CHUNK = 1 << 19


class Chunk:
    """Texts joined by line breaks: ``first`` is the place of the first of them, ``edges`` where each one's words begin (the last is the end)."""

    def __init__(self, first: int, texts: list[bytes]) -> None:
        self.first, self.data = first, b"\n".join(texts)
        self.starts, self.ends = word_spans(self.data)
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.edges = np.searchsorted(self.starts, offsets)
        self.owner = np.repeat(np.arange(len(texts)), np.diff(self.edges))

    def words(self) -> np.ndarray:
        data = self.data.lower()
        return _hash_spans(data, self.starts, self.ends) if len(data) <= 2 * PIECE else word_hashes(data)

    def inside(self, width: int) -> np.ndarray:
        """For each place at which ``width`` words begin: whether they are one text's."""
        n = max(0, len(self.owner) - width + 1)
        return self.owner[:n] == self.owner[width - 1 : width - 1 + n]


def chunks(texts: list[bytes | None]) -> Iterator[Chunk]:
    """The texts in order, some at a time; a null is an empty text."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        text = text or b""
        if held and size + len(text) > CHUNK:
            yield Chunk(first, held)
            first, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield Chunk(first, held)


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """shingle_set of each text in lower case."""
    found = []
    for chunk in chunks(texts):
        words = chunk.words()
        windows = window_hashes(words, width) if len(words) >= width else words[:0]
        for a, b in itertools.pairwise(chunk.edges.tolist()):
            found.append(distinct(windows[a : b - width + 1] if b - a >= width else window_hashes(words[a:b], width)))
    return found
