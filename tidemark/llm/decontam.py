"""Benchmark decontamination by the q-gram lemma.

A document holds an item if some window of LEAST_CHARS characters of the item (the whole item, if it is shorter) is
within the window's edit budget of a region of the text.  Such a region shares at least m + 1 - q - q k of the window's
q-grams, near one diagonal (text offset less item offset).  Shared q-grams are counted in overlapping bands of
diagonals; bands that reach the bound are verified by alignment inside the band.  Characters are bytes of the
lower-cased text with single spaces, and q is 8, so a q-gram is one 64-bit integer and isn't hashed.  Items of fewer
than 8 bytes are searched as whole words, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import cut, fresh, may_match, slices

Q = 8
#: A match covers a window of this many characters of the item, or the whole of a shorter item, ...
LEAST_CHARS = 80
#: ... with one edit in this many characters at most.
CHARS_PER_EDIT = 12
#: Pairs of text and item places that are counted at once.
PIECE_PAIRS = 1 << 21
#: Diagonals of a band; bands overlap by half.
BAND = 32
#: Local alignment scores: a match, and an edit.
GAIN, LOSS = 1, 3
#: Bytes of items that one pass over the documents compares; more items take more passes.
PASS_BYTES = 8 << 20
_SLOT_BITS = 22


def normal(text: str) -> bytes:
    return " ".join(text.lower().split()).encode()


def grams(data: bytes) -> np.ndarray:
    """The 8-byte windows of data, as integers."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    found = np.empty(n, dtype=np.uint64)
    for k in range(min(Q, n)):
        count = (len(data) - k) // Q
        found[k::Q] = np.frombuffer(data, dtype="<u8", offset=k, count=count)[: len(found[k::Q])]
    return found


def edit_budget(chars: int) -> int:
    return chars // CHARS_PER_EDIT


def least_shared(chars: int) -> int:
    """The lemma's bound, 1 at least."""
    return max(1, chars + 1 - Q - Q * edit_budget(chars))


def least_score(chars: int) -> int:
    """What a region of so many characters scores if it just keeps to the budget."""
    edits = edit_budget(chars)
    return GAIN * (chars - edits) - LOSS * edits


def banded_score(item: np.ndarray, text: np.ndarray, low: int, width: int) -> tuple[int, int, int]:
    """(score, start, end) of the best local alignment on the diagonals low .. low + width - 1.

    Diagonal d pairs item byte j with text byte j + d.  start and end are text offsets.
    """
    d = np.arange(width)
    ramp = LOSS * d
    score = np.zeros(width + 1, dtype=np.int64)  # one more: what comes from beyond the band
    begin = np.zeros(width + 1, dtype=np.int64)
    best, where = 0, (0, 0)
    for j in range(len(item)):
        at = j + low + d
        inside = (at >= 0) & (at < len(text))
        hit = inside & (text[np.clip(at, 0, len(text) - 1)] == item[j])
        step = score[:-1] + np.where(hit, GAIN, -LOSS)
        since = np.where(score[:-1] > 0, begin[:-1], at)
        skip = score[1:] - LOSS  # an item byte without a text byte: from the next diagonal
        take = skip > step
        step, since = np.where(take, skip, step), np.where(take, begin[1:], since)
        raised = step + ramp  # text bytes without an item byte: from diagonals before
        top = np.maximum.accumulate(raised)
        source = np.maximum.accumulate(np.where(raised == top, d, 0))
        step, since = top - ramp, since[source]
        step = np.where(inside, np.maximum(step, 0), 0)
        score[:-1], begin[:-1] = step, since
        k = int(np.argmax(step))
        if step[k] > best:
            best, where = int(step[k]), (int(since[k]), int(at[k]) + 1)
    return best, *where


def ungapped_window(item: np.ndarray, text: np.ndarray, low: int, width: int, chars: int) -> tuple[int, int, int]:
    """(edits, start, end): the window of ``chars`` item bytes with the fewest mismatches on one of the band's diagonals."""
    at = np.arange(len(item)) + (low + np.arange(width))[:, None]
    miss = ~((at >= 0) & (at < len(text)) & (text[np.clip(at, 0, len(text) - 1)] == item))
    sums = np.zeros((width, len(item) + 1), dtype=np.int64)
    np.cumsum(miss, axis=1, out=sums[:, 1:])
    windows = sums[:, chars:] - sums[:, :-chars]
    d, j = np.unravel_index(np.argmin(windows), windows.shape)
    start = int(low + d + j)
    return int(windows[d, j]), max(0, start), min(len(text), start + chars)


def banded_window(item: np.ndarray, text: np.ndarray, low: int, width: int, chars: int) -> tuple[int, int, int]:
    """(edits, start, end): the window of ``chars`` item bytes with the fewest edits to a region of the text inside the band.

    All windows are aligned at once, a row each, byte by byte.
    """
    d = np.arange(width)
    first = np.arange(len(item) - chars + 1)[:, None]
    edits = np.zeros((len(first), width), dtype=np.int64)
    begin = first + low + d
    for j in range(chars):
        at = first + j + low + d
        inside = (at >= 0) & (at < len(text))
        hit = inside & (text[np.clip(at, 0, len(text) - 1)] == item[first + j])
        step, since = edits + ~hit, begin
        skip = np.full_like(edits, 1 << 20)
        skip[:, :-1] = edits[:, 1:] + 1  # an item byte without a text byte: from the next diagonal
        moved = np.zeros_like(begin)
        moved[:, :-1] = begin[:, 1:]
        since = np.where(skip < step, moved, since)
        step = np.minimum(step, skip)
        level = step - d  # text bytes without an item byte: from diagonals before
        low_level = np.minimum.accumulate(level, axis=1)
        source = np.maximum.accumulate(np.where(level == low_level, d, 0), axis=1)
        edits, begin = low_level + d, np.take_along_axis(since, source, axis=1)
    i, k = np.unravel_index(np.argmin(edits), edits.shape)
    return int(edits[i, k]), max(0, int(begin[i, k])), min(len(text), int(i + chars - 1 + low + k) + 1)


class Items:
    """The items of one pass, by q-gram."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        plain = [(i, normal(t)) for i, t in items if t]
        kept = [(i, data) for i, data in plain if len(data) >= Q]
        #: Items below q bytes, by their first word.
        self.short: dict[bytes, list[tuple[int, bytes]]] = {}
        for i, data in plain:
            if 0 < len(data) < Q:
                self.short.setdefault(data.split(b" ")[0], []).append((i, data))
        self.ids = [i for i, _ in kept]
        self.data = [np.frombuffer(x, dtype=np.uint8) for _, x in kept]
        self.raw = [x for _, x in kept]
        self.longest = max(map(len, self.raw), default=0)
        codes = [grams(x) for _, x in kept]
        sizes = [len(c) for c in codes]
        flat = np.concatenate(codes) if codes else np.empty(0, dtype=np.uint64)
        order = np.argsort(flat, kind="stable")
        self.item = np.repeat(np.arange(len(kept)), sizes)[order]
        self.offset = np.concatenate([np.arange(s) for s in sizes] or [np.empty(0, dtype=np.int64)])[order]
        self.codes, first = np.unique(flat[order], return_index=True)
        self.first = np.append(first, len(flat))
        self.filter = np.zeros(1 << _SLOT_BITS, dtype=bool)
        self.filter[self._slots(self.codes)] = True
        chars = [min(len(x), LEAST_CHARS) for x in self.raw]
        self.bound = np.array([least_shared(c) for c in chars], dtype=np.int64)
        self.reach = np.array([c + edit_budget(c) - Q for c in chars], dtype=np.int64)
        self.chars = chars
        self.score = [least_score(c) for c in chars]

    @staticmethod
    def _slots(codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOT_BITS)

    def exact_words(self, data: bytes) -> list[tuple[int, int]]:
        """(item id, start) of short_matches()."""
        return [(i, at) for i, at, _ in self.short_matches(data)]

    def short_matches(self, data: bytes) -> list[tuple[int, int, int]]:
        """(item id, start, words) of the items below q bytes that data holds as whole words."""
        if not self.short:
            return []
        padded, found = b" " + data + b" ", []
        for word in self.short.keys() & set(data.split(b" ")):
            found += [(i, at, item.count(b" ") + 1) for i, item in self.short[word] if (at := padded.find(b" " + item + b" ")) >= 0]
        return sorted(found)

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item index, start, end, edits) of each item that the text holds: a region in budget, in normal bytes."""
        data = normal(text)
        codes = grams(data)
        if not len(codes) or not len(self.codes):
            return []
        at = np.flatnonzero(self.filter[self._slots(codes)])
        place = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
        real = self.codes[place] == codes[at]
        at, place = at[real], place[real]
        if not len(at):
            return []
        counts = self.first[place + 1] - self.first[place]
        bands: dict[int, int] = {}
        # Places are counted some at a time, from one region's length before the last ones: repeats can't exhaust memory.
        ends, reach, done = np.cumsum(counts), int(self.reach.max()), 0
        while done < len(at):
            back = int(np.searchsorted(at, at[done] - reach))
            base = int(ends[back - 1]) if back else 0
            stop = max(done + 1, int(np.searchsorted(ends, base + PIECE_PAIRS, side="right")))
            for band, dense in zip(*self._bands(at[back:stop], place[back:stop], counts[back:stop]), strict=True):
                bands[int(band)] = max(bands.get(int(band), 0), int(dense))
            done = stop
        found: dict[int, tuple[int, int, int]] = {}
        text_bytes = np.frombuffer(data, dtype=np.uint8)
        for band, _ in sorted(bands.items(), key=lambda x: (-x[1], x[0])):
            i = band >> 40
            if i in found:
                continue
            got = self._verify(i, data, text_bytes, (band & ((1 << 40) - 1)) * (BAND // 2) - self.longest - BAND)
            if got[0] <= edit_budget(self.chars[i]):
                found[i] = (got[1], got[2], got[0])
        return [(i, *found[i]) for i in sorted(found)]

    def _bands(self, at: np.ndarray, place: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bands in which the q-grams at these places of the text reach the bound, and how dense they are."""
        ends = np.cumsum(counts)
        rows = np.arange(ends[-1]) - np.repeat(ends - counts, counts) + np.repeat(self.first[place], counts)
        item, spot, offset = self.item[rows], np.repeat(at, counts), self.offset[rows]
        half = (spot - offset + self.longest + BAND) // (BAND // 2)
        # Each q-gram counts for the two bands that overlap at its diagonal.
        keys = np.concatenate([(item << 40) | half, (item << 40) | (half - 1)])
        bands, dense = self._dense(keys, np.concatenate([spot, spot]))
        if not len(bands):
            return bands, dense
        # The shared q-grams of a region have places of their own in the item too: repeats of few don't add up.
        kept = np.isin(keys, bands)
        again, enough = self._dense(keys[kept], np.concatenate([offset, offset])[kept])
        both, first, second = np.intersect1d(bands, again, assume_unique=True, return_indices=True)
        return both, np.minimum(dense[first], enough[second])

    def _dense(self, keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bands (keys) in which as many places as the bound asks for lie within a region's length, and how often."""
        order = np.lexsort((places, keys))
        keys, places = keys[order], places[order]
        new = np.append(True, (keys[1:] != keys[:-1]) | (places[1:] != places[:-1]))
        keys, places = keys[new], places[new]
        ahead = np.arange(len(keys)) + self.bound[keys >> 40] - 1
        fits = np.minimum(ahead, len(keys) - 1)
        good = (ahead < len(keys)) & (keys[fits] == keys) & (places[fits] - places <= self.reach[keys >> 40])
        return np.unique(keys[good], return_counts=True)

    def _verify(self, i: int, data: bytes, text: np.ndarray, low: int) -> tuple[int, int, int]:
        """(edits, start, end) of a window of the item in the band, with more edits than the budget if there is none in it."""
        raw, chars = self.raw[i], self.chars[i]
        whole = data.find(raw, max(0, low), max(0, min(len(data), low + BAND + len(raw))))
        if whole >= 0:
            return 0, whole, whole + len(raw)
        plain = ungapped_window(self.data[i], text, low, BAND, chars)
        if plain[0] <= edit_budget(chars):
            return plain
        if banded_score(self.data[i], text, low, BAND)[0] < self.score[i]:  # what a window in budget scores at least
            return plain
        return banded_window(self.data[i], text, low, BAND, chars)


MATCH_SCHEMA = "doc_id long, item_id long, start_word int, n_words int, edits int, exact boolean"


def _one_pass(rows: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(items)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Items(shared.value)
        for batch in slices(batches):
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                data = normal(text)
                for i, start, end, edits in index.matches(text):
                    before = data.count(b" ", 0, start)
                    words = data.count(b" ", start, end) + 1
                    out.append((doc, index.ids[i], before, words, edits, edits == 0 and end - start == len(index.raw[i])))
                for item, start, words in index.short_matches(data):
                    out.append((doc, item, data.count(b" ", 0, start), words, 0, True))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
            yield pa.record_batch(
                [pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "item_id", "start_word", "n_words", "edits", "exact"],
            )

    return rows.mapInArrow(search, MATCH_SCHEMA)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, edits, exact): a row for each document and item that it holds.

    The row tells a region in budget, in the band that shares most with the item.  Items go to the executors in blocks of at most
    PASS_BYTES; each block is compared with all documents.  Null and blank items and texts match nothing; items without
    an id match as others do; items that repeat with their id count once; rows that repeat a doc_id are searched each by itself; a null doc_id stays null.  Very long
    texts are searched whole.  Empty tables give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = -(-2 * total // PASS_BYTES) if total > PASS_BYTES else 1
    found = None
    for k in range(passes):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        part = _one_pass(rows, [tuple(r) for r in block.collect()])
        found = part if found is None else found.union(part)
    return found


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, with their own columns; rows without doc_id stay."""
    bad = cut(
        contaminated(docs.where(F.col("doc_id").isNotNull()), benchmark).select(F.col("doc_id").alias("tm_bad")).distinct()
    )
    hit = fresh(docs, "hit")
    marked = may_match(docs, "doc_id", bad, "tm_bad", flag=hit)
    unsure = marked.where(F.col(hit)).drop(hit)
    left = unsure.join(bad, unsure["doc_id"] == bad["tm_bad"], "left_anti")
    return marked.where(~F.col(hit)).drop(hit).unionByName(left)
