"""Runs of repeated words: maximal stretches with a period, found in a suffix tree of word sequences.

The tree is kept as arrays: the order of all suffixes, by prefix doubling, and the length that neighbours share.  A node
is a stretch of that order, its depth the length that its suffixes share.  A word sequence aa, after which the
word differs from the first of its second half, is a branching tandem repeat: both places of a are leaves below one node,
whose depth is a's length, and in different children.  So every leaf in a child other than its node's largest
is tried, with the leaf that lies a depth further and the one that lies a depth before.  A leaf is in at most log n such
children.  Each repeat is then rotated to the left as long as words agree; repeats with the same ends are one
run, of the smallest period.

Texts are indexed together, up to a bound, and no suffix of one text shares words with one of another.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import slices
from tidemark.llm.quality import word_array
from tidemark.llm.textkit import chunks, mix, word_hashes

#: A run has this many words at least, and this many periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Leaves that are tried at once.
LEAVES = 1 << 20

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The suffixes in order, each one's rank, and for k = 0, 1 ... ranks by the first 2^k words alone (equal where these are).

    A round sorts only suffixes that earlier ones left tied.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable").astype(np.int64)
    sorted_ids = ids[order]
    new = np.empty(n, dtype=bool)
    new[:1] = True
    np.not_equal(sorted_ids[1:], sorted_ids[:-1], out=new[1:])
    rank = np.empty(n, dtype=np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, step = [rank.copy()], 1
    slots = np.arange(n)
    while True:
        # Tied are the slots that begin no group, and those before them.
        follows = ~new
        tied = follows.copy()
        tied[:-1] |= follows[1:] & (slots[1:] == slots[:-1] + 1)
        slots = slots[tied]
        if not len(slots):
            return order, rank, levels
        at = order[slots]
        ahead = at + step
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)].astype(np.int64) + 1, 0)
        key = rank[at].astype(np.int64) * (n + 1) + second
        by = np.argsort(key, kind="stable")
        key, at = key[by], at[by]
        order[slots] = at
        new = np.empty(len(slots), dtype=bool)
        new[0] = True
        np.not_equal(key[1:], key[:-1], out=new[1:])
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        levels.append(rank.copy())
        step *= 2


def shared_lengths(order: np.ndarray, levels: Sequence[np.ndarray]) -> np.ndarray:
    """For each place in the order, how many words its suffix shares with the one before; one more zero at the end."""
    n = len(order)
    shared = np.zeros(n + 1, dtype=np.int64)
    first = levels[0]
    slots = np.flatnonzero(first[order[1:]] == first[order[:-1]]) + 1
    i, j = order[slots - 1].copy(), order[slots].copy()
    for k in range(len(levels) - 1, -1, -1):
        inside = np.maximum(i, j) < n
        equal = inside.copy()
        equal[inside] = levels[k][i[inside]] == levels[k][j[inside]]
        step = equal.astype(np.int64) << k
        i += step
        j += step
    shared[slots] = j - order[slots]
    return shared


def _nearest_smaller(shared: np.ndarray, slots: np.ndarray, side: int) -> np.ndarray:
    """For each slot, the nearest one on that side (-1 or 1) that shares less.

    Pointers jump over what is known to share as much or more; zeros are never passed.
    """
    found = np.arange(len(shared)) + side
    todo = slots
    while len(todo):
        at = found[todo]
        todo = todo[shared[at] >= shared[todo]]
        found[todo] = found[found[todo]]
    return found[slots]


def _light_children(shared: np.ndarray) -> tuple[np.ndarray, ...]:
    """(child's start, its end, node's start, its end, depth) of all children but the largest, of nodes with enough leaves."""
    slots = np.flatnonzero(shared)
    lo, hi = _nearest_smaller(shared, slots, -1), _nearest_smaller(shared, slots, 1)
    enough = hi - lo >= LEAST_PERIODS
    slots, lo, hi = slots[enough], lo[enough], hi[enough]
    by = np.lexsort((slots, hi, lo))  # a node's slots, one after another
    slots, lo, hi = slots[by], lo[by], hi[by]
    if not len(slots):
        return (slots,) * 5
    opens = np.append(True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))
    first = np.flatnonzero(opens)
    node = np.cumsum(opens) - 1
    ends = np.append(slots[1:], 0)
    last = np.append(first[1:], len(slots)) - 1
    ends[last] = hi[last]
    # A child before the node's first slot, and one after each slot.
    start = np.concatenate([lo[first], slots])
    end = np.concatenate([slots[first], ends])
    owner = np.concatenate([node[first], node])
    size = end - start
    largest = np.lexsort((size, owner))
    heavy = largest[np.append(owner[largest][1:] != owner[largest][:-1], True)]
    light = np.ones(len(start), dtype=bool)
    light[heavy] = False
    owner = owner[light]
    return start[light], end[light], lo[first][owner], hi[first][owner], shared[slots[first]][owner]


def _branching(ids: np.ndarray, order: np.ndarray, rank: np.ndarray, shared: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, half's length) of the branching tandem repeats, some twice."""
    begin, end, lo, hi, depth = _light_children(shared)
    until = np.cumsum(end - begin)
    word = np.append(ids, -1)
    for at in range(0, int(until[-1]) if len(until) else 0, LEAVES):
        place = np.arange(at, min(at + LEAVES, until[-1]))
        child = np.searchsorted(until, place, side="right")
        leaf = order[end[child] - until[child] + place]
        yield from _tried(word, leaf, rank, lo[child], hi[child], depth[child])


def _tried(word: np.ndarray, leaf: np.ndarray, rank: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    n = len(rank)
    for i, other in ((leaf, leaf + depth), (leaf - depth, leaf - depth)):
        inside = (other >= 0) & (other < n)
        at = rank[np.where(inside, other, 0)]
        hit = np.flatnonzero(inside & (at >= lo) & (at < hi))
        j, d = (i + depth)[hit], depth[hit]
        # The words after the halves differ, so the leaves are in different children.
        ends = word[j] != word[np.minimum(j + d, n)]
        yield (j - d)[ends], d[ends]


def _rotated(ids: np.ndarray, levels: Sequence[np.ndarray], start: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, period) of the stretches of enough words that the repeats belong to."""
    least = np.maximum(LEAST_WORDS, LEAST_PERIODS * period) - 2 * period
    enough = start >= least
    start, period, least = start[enough], period[enough], least[enough]
    likely = (ids[start - 1] == ids[start - 1 + period]) & (ids[start - least] == ids[start - least + period])
    start, period, least = start[likely], period[likely], least[likely]
    at = start.copy()
    for k in range(len(levels) - 1, -1, -1):
        back = at - (1 << k)
        inside = back >= 0
        inside[inside] = levels[k][back[inside]] == levels[k][back[inside] + period[inside]]
        at = np.where(inside, back, at)
    full = start - at >= least
    return at[full], (start + 2 * period)[full], period[full]


def maximal_runs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of a sequence of integers, by start and period."""
    none = np.empty(0, dtype=np.int64)
    if len(ids) < LEAST_WORDS:
        return none, none, none
    order, rank, levels = suffix_order(ids)
    shared = shared_lengths(order, levels)
    found = [_rotated(ids, levels, *repeats) for repeats in _branching(ids, order, rank, shared)]
    start, end, period = (np.concatenate([f[x] for f in found]) if found else none for x in range(3))
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    one = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))[: len(start)]
    start, end, period = start[one], end[one], period[one]
    by = np.lexsort((period, start))
    return start[by], (end - start)[by], period[by]


def collapsed(text: bytes, runs: Sequence[tuple[int, int, int]]) -> bytes:
    """The text's words, joined by one space, without what a run holds after its first period."""
    found = text.split()
    if runs:
        stay = np.ones(len(found), dtype=bool)
        for start, length, period in runs:
            stay[start + period : start + length] = False
        found = [found[i] for i in np.flatnonzero(stay).tolist()]
    return b" ".join(found)


def text_runs(texts: list[bytes | None]) -> Iterator[list[tuple[int, int, int]]]:
    """For each text, its runs as (start, length, period), by start and period."""
    for chunk in chunks(texts):
        words = word_hashes(chunk.data)
        # Equal words of two texts are different words, so no suffixes of two texts share any.
        ids = np.unique(words ^ mix(chunk.owner.astype(np.uint64)), return_inverse=True)[1].astype(np.int64)
        start, length, period = maximal_runs(ids)
        at = np.searchsorted(start, chunk.edges)
        for k in range(len(chunk.edges) - 1):
            a, b = at[k], at[k + 1]
            yield list(zip((start[a:b] - chunk.edges[k]).tolist(), length[a:b].tolist(), period[a:b].tolist(), strict=True))


def periodic_runs(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns of each row of docs, with ``runs`` and ``collapsed``, the text without repeats inside runs.

    Words are separated by the six ASCII blanks and compared as they are.  A run is a stretch of consecutive
    words with smallest period p, of max(6, 4 p) words at least, that no neighbouring word extends; runs are ordered by start,
    then period.  A null or empty text has no words: no runs and an empty ``collapsed``.  Repeated rows are rows of their
    own; other columns of docs don't matter; an empty table gives no rows.  Very long texts are read whole: a text takes
    about 100 bytes a word, and 4 more for each doubling of its longest repeat, inside one task.
    """
    named = [f"tm_{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, named, strict=True)), F.col(f"`{text}`").alias("tm_text"))
    kinds = dict(rows.dtypes)
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("tm_text").cast(pa.binary()).to_pylist()
            runs = list(text_runs(texts))
            rest = [collapsed(t or b"", r) for t, r in zip(texts, runs, strict=True)]
            flat = np.array([x for r in runs for x in r], dtype=np.int64).reshape(-1, 3)
            values = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(run))
            offsets = np.cumsum([0, *map(len, runs)]).astype(np.int32)
            yield pa.record_batch(
                [*(batch.column(n) for n in named), pa.ListArray.from_arrays(offsets, values), pa.array(rest, pa.binary()).cast(pa.string())],
                names=[*named, "runs", "collapsed"],
            )

    schema = ", ".join(f"{n} {kinds[n]}" for n in named)
    found = rows.mapInArrow(searched, f"{schema}, runs {RUNS}, collapsed string")
    return found.select(*(F.col(n).alias(c) for n, c in zip(named, keep, strict=True)), "runs", "collapsed")


def with_planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the texts, by the id's CRC-32, the words from a place on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = word_array(F.col("text"))
    n = F.greatest(F.size(words), F.lit(1)).cast("long")
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))

    def part(array: Column, start: Column, length: Column) -> Column:
        return F.slice(array, start.cast("int"), length.cast("int"))

    times = F.ceil((n - a) / p).cast("int")
    cycle = part(F.flatten(F.array_repeat(part(words, a + 1, p), times)), F.lit(1), n - a)
    planted = F.array_join(F.concat(part(words, F.lit(1), a), cycle), " ")
    chosen = (F.pmod(h, F.lit(10)) == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return docs.select("doc_id", F.when(chosen, planted).otherwise(F.col("text")).alias("text"))


def run_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of the runs after with_planted().

    Nulls: as in periodic_runs; a null doc_id's text stays as it is.
    """
    found = periodic_runs(with_planted(docs))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.when(F.size("runs") > 0, F.concat(F.array_join(listed, "\n"), F.lit("\n"))).otherwise("")
    return found.withColumn("best", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("-1000 * best.less div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Runs as stretches of places whose words return after q places: every pair of equal words within a quarter of the text.
RUN_SQL = r"""
WITH crc AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS tab
  FROM range(256) t(i)
), h AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h
  FROM documents, crc
), g AS (
  SELECT *, h // 10 AS g, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a FROM h
), d AS (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_concat(w[1:a], list_transform(range(n - a), lambda i: w[a + i % (1 + (n - a) // (3 + g % 8)) + 1])) ELSE w END AS w FROM g
), x AS (
  SELECT r, i - 1 AS i, w[i] AS x, n FROM (SELECT r, w, n, unnest(range(1, n + 1)) AS i FROM d)
), p AS (
  SELECT a.r, b.i - a.i AS q, a.i FROM x a JOIN x b ON a.r = b.r AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n
), s AS (
  SELECT r, q, min(i) AS s, max(i) + q + 1 AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM p) GROUP BY r, q, k HAVING count(*) + q >= greatest(6, 4 * q)
), u AS (
  SELECT r, s, e - s AS l, min(q) AS q FROM s GROUP BY r, s, e
), m AS (
  SELECT r, count(*) AS n_runs, min((-l, s, q)) AS best, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines, list((s + q, s + l)) AS cuts FROM u GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best[2] AS start, -best[1] AS length, best[3] AS period, -1000 * best[1] // best[3] AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(array_to_string(CASE WHEN cuts IS NULL THEN w ELSE list_transform(list_filter(range(n), lambda i: len(list_filter(cuts, lambda c: i >= c[1] AND i < c[2])) = 0), lambda i: w[i + 1]) END, ' ')) AS collapsed_sha256
FROM d LEFT JOIN m USING (r)
"""
