"""Substring dedup: paragraphs that repeat across documents, by MinHash banding.

Units are lines, and the sentences inside them, because passages are spliced into lines as well.  Each unit has bands of
ROWS minima of its five-word shingles: LINE_BANDS for a line (a pair at 0.8 collides with a chance of 99.4 in 100),
SENTENCE_BANDS for a sentence inside one (95.3 in 100), one for units below BANDED_WORDS, which are at 0.8 to their
equals only.  Units that collide are verified by the exact Jaccard of their shingles and grouped into components.  A
component stays in its smallest document, its owner, and goes from the others, where units add up to passages of
PASSAGE_WORDS.  Units add up only if they have one owner and lie in its text in the same order and as close.  What lies
between them belongs to the passage only if, taken as edits, it leaves the passage at PERCENT of its words.

Repeats that start or end inside sentences, and runs of shorter lines, are found by windows of WINDOW_WORDS words at every
place.  Windows are spread only near anchors that documents share and that no repeated units cover somewhere: of each
ANCHOR_SPAN windows in a row the one of the least hash is an anchor, so two texts that share ANCHOR_SPAN + WINDOW_WORDS - 1 =
30 words in a row share an anchor there, wherever they lie.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import linking
from tidemark.llm.frames import cut, discard, each_salt, fresh, may_match, salt, salts, slices, tidy, with_group
from tidemark.llm.linking import arrays
from tidemark.llm.textkit import Chunk, chunks, mix, run_hashes, shingle_sets, window_hashes, word_spans

WIDTH = 5
PERCENT = 80
ROWS = 2
LINE_BANDS, SENTENCE_BANDS = 5, 3
#: A word added at an end adds one shingle to n - 4: from here on unequal units can meet 0.8 (4 of 5).
BANDED_WORDS = 8
#: Shorter lines and sentences aren't units: runs of them are found by windows.
UNIT_WORDS = 6
#: Units that lie further apart, in either text, aren't of one passage.
BRIDGE_WORDS = 10
PASSAGE_WORDS = 30
WINDOW_WORDS = 12
ANCHOR_SPAN = PASSAGE_WORDS - WINDOW_WORDS + 1
#: Windows so far from a shared anchor's span are spread as well: the shorter runs beside a changed word.
MARGIN = ANCHOR_SPAN + WINDOW_WORDS - 1 + BRIDGE_WORDS

_ENDS = np.zeros(256, dtype=bool)
_ENDS[list(b".!?")] = True
_SEEDS = mix(np.arange(1, LINE_BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_TOP = np.uint64((1 << 64) - 1)


def unit_spans(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, bands) of the chunk's units, in words: lines, and sentences that aren't whole lines."""
    n = len(chunk.starts)
    if not n:
        return (np.empty(0, dtype=np.int64),) * 3
    codes = np.frombuffer(chunk.data, dtype=np.uint8)
    line = np.searchsorted(np.flatnonzero(codes == 10), chunk.starts)
    turn = np.ones(n + 1, dtype=bool)  # a line begins at this word
    turn[1:-1] = line[1:] != line[:-1]
    stop = turn.copy()
    stop[1:-1] |= _ENDS[codes[chunk.ends[:-1] - 1]]
    lines, sentences = np.flatnonzero(turn), np.flatnonzero(stop)
    inner = ~(turn[sentences[:-1]] & turn[sentences[1:]])
    begin = np.concatenate([lines[:-1], sentences[:-1][inner]])
    end = np.concatenate([lines[1:], sentences[1:][inner]])
    bands = np.where(np.arange(len(begin)) < len(lines) - 1, LINE_BANDS, SENTENCE_BANDS)
    keep = end - begin >= UNIT_WORDS
    begin, end = begin[keep], end[keep]
    return begin, end, np.where(end - begin < BANDED_WORDS, 1, bands[keep])


def band_keys(shingles: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The LINE_BANDS band keys of each run shingles[begin:end], a row each; a sentence takes the first of them."""
    places = np.ravel(np.column_stack([begin, end]))
    keys = np.zeros((len(begin), LINE_BANDS), dtype=np.uint64)
    values = np.empty(len(shingles) + 1, dtype=np.uint64)
    values[-1] = _TOP
    for i, seed in enumerate(_SEEDS):  # the hashes are mixed; odd factors permute them
        np.multiply(shingles, seed, out=values[:-1])
        keys[:, i // ROWS] = mix(keys[:, i // ROWS] + np.minimum.reduceat(values, places)[::2])
    return mix(keys + np.arange(LINE_BANDS, dtype=np.uint64))


def least_places(values: np.ndarray, span: int) -> np.ndarray:
    """The place of the least of the ``span`` values from each place on, the first of equal ones, by stretches of doubled length."""
    least, at, length = values, np.arange(len(values)), 1
    while length < span:
        step = min(length, span - length)
        n = len(least) - step
        at = np.where(least[step:] < least[:n], at[step:], at[:n])
        least = np.minimum(least[step:], least[:n])
        length += step
    return at


def anchors(chunk: Chunk, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, spans, chosen): the hash of the window at each word; where PASSAGE_WORDS words of one text begin, and the place
    of the least of the ANCHOR_SPAN windows there."""
    spans = np.flatnonzero(chunk.inside(PASSAGE_WORDS))
    if not len(spans):
        return words[:0], spans, spans
    windows = window_hashes(words, WINDOW_WORDS)
    return windows, spans, least_places(windows, ANCHOR_SPAN)[spans]


def units_of(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(begin, words, key, n_buckets, buckets) of the chunk's units, and then of its anchors, whose words are 0."""
    words = chunk.words()
    begin, end, bands = unit_spans(chunk)
    key, flat = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64)
    if len(begin):
        key = run_hashes(words, begin, end)
        rows = band_keys(window_hashes(words, WIDTH), begin, end - WIDTH + 1)
        flat = rows[np.arange(LINE_BANDS) < bands[:, None]]
    windows, _, chosen = anchors(chunk, words)
    at = chosen[np.append(True, chosen[1:] != chosen[:-1])[: len(chosen)]]  # the places ascend
    near = windows[at]
    return (
        np.concatenate([begin, at]),
        np.concatenate([end - begin, np.zeros(len(at), dtype=np.int64)]),
        np.concatenate([key, near]),
        np.concatenate([bands, np.ones(len(at), dtype=np.int64)]),
        np.concatenate([flat, near]),
    )


def _documents(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), "text")


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def units(docs: DataFrame) -> DataFrame:
    """(id, start, words, key, buckets) of each unit and anchor; words are 0 for anchors."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = np.array(batch.column("id"), dtype=np.int64)
            for chunk in chunks(_texts(batch)):
                begin, words, key, n, flat = units_of(chunk)
                mine = chunk.owner[begin]
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.record_batch(
                    [
                        pa.array(ids[chunk.first + mine]),
                        pa.array((begin - chunk.edges[mine]).astype(np.int32)),
                        pa.array(words.astype(np.int32)),
                        _long(key),
                        pa.ListArray.from_arrays(offsets, _long(flat)),
                    ],
                    names=["id", "start", "words", "key", "buckets"],
                )

    return _documents(docs).mapInArrow(split, "id long, start int, words int, key long, buckets array<bigint>")


def _unit_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, text) of one unit for each key in wanted (id)."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for chunk in chunks(_texts(batch)):
                begin, end, _ = unit_spans(chunk)
                long = end - begin >= BANDED_WORDS
                begin, end = begin[long], end[long]
                keys = run_hashes(chunk.words(), begin, end) if len(begin) else begin
                keys, once = np.unique(keys, return_index=True)
                begin, end = begin[once], end[once]
                texts = [chunk.data[a:b] for a, b in zip(chunk.starts[begin].tolist(), chunk.ends[end - 1].tolist(), strict=True)]
                yield pa.record_batch([_long(keys), pa.array(texts, type=pa.binary())], names=["id", "text"])

    found = _documents(docs).select("text").mapInArrow(pick, "id long, text binary")
    return cut(may_match(found, "id", wanted).join(wanted, "id", "left_semi").groupBy("id").agg(F.first("text").alias("text")))


def unit_components(docs: DataFrame, met: DataFrame) -> DataFrame:
    """(id, component) of the keys of units that others resemble, from (key, n_buckets, bucket) of each unit."""
    classes = met.groupBy("bucket", "key").agg(F.first("n_buckets").alias("n_buckets"))
    mixed = classes.groupBy("bucket").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi")
    postings = cut(classes.join(mixed, "bucket").select(F.col("key").alias("id"), "bucket", "lo", "hi"))
    texts = _unit_texts(docs, cut(postings.select("id").distinct()))

    def make(texts: list[bytes | None]) -> list[np.ndarray]:
        return shingle_sets(texts, WIDTH)

    led = postings.select("id", F.explode(F.array("lo", "hi")).alias("lead")).where("id <> lead")
    pairs = led.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()
    labels = cut(linking.components(linking.verify(pairs, texts, make, PERCENT)))
    # A bucket's leaders are verified with all of its units; what is left are its other units, if they are of several components.
    # Near copies of one unit meet in many buckets: those are compared by their differences from one of them, and
    # only what no chain of leaders ties meets pair by pair.
    placed = linking.with_component(postings.where("id <> lo AND id <> hi").select("id", "bucket"), labels)
    open_buckets = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    apart = cut(placed.join(open_buckets.select("bucket"), "bucket", "left_semi"))
    pivot = cut(linking.merged(apart, cut(linking.gathered(apart))))
    certain, near = linking.around_pivots(texts, linking.with_component(pivot, labels), make, PERCENT)
    pairs = apart.join(pivot, "id").select(
        "bucket", "id", F.lit(1).alias("n"), "component", F.lit(1).alias("need"), F.lit(0).alias("free"), "pivot"
    )
    links = linking.verify(linking.across(pairs, PERCENT).union(near), texts, make, PERCENT).union(certain)
    found = linking.relabel(labels, links)
    for spent in (postings, texts, apart):
        discard(spent)
    return found


def _narrow(docs: DataFrame) -> bool:
    """Whether an id and a place in its text fit one long together: the least of longs is hashed, that of structs is sorted for."""
    low, high = _documents(docs).agg(F.min("id"), F.max("id")).first()
    return low is None or -(1 << 31) <= low <= high < 1 << 31


def _first_place(ident: str, narrow: bool) -> Column:
    """An aggregate: the smallest (ident, start), for _place()."""
    return F.min(F.shiftleft(ident, 32) + F.col("start")) if narrow else F.min(F.struct(F.col(ident).alias("doc"), "start"))


def _place(first: str, narrow: bool) -> tuple[Column, Column]:
    """(document, start) of what _first_place() found."""
    if not narrow:
        return F.col(f"{first}.doc"), F.col(f"{first}.start")
    return F.shiftright(first, 32), F.col(first).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def uncovered(places: DataFrame, held: DataFrame) -> DataFrame:
    """(key) of the anchors (id, start, key) that lie outside the passages of repeated units (id and UNIT) in some document."""
    *nothing, no_key = (F.lit(0).cast("long" if c in ("owner", "key") else "int").alias(c) for c in (*UNIT[1:], "key"))
    spots = places.select("id", "start", *nothing, "key")  # units have words
    both = spots.union(held.select("id", *UNIT, no_key)).repartition("id").sortWithinPartitions("id")

    def outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in itertools.batched(_by_document(batches, (*UNIT, "key")), 400):
            keys = [np.empty(0, dtype=np.int64)]
            for doc, columns in some:
                spot = columns[1] == 0
                at, key = columns[0][spot], columns[-1][spot]
                begin, size = covered(doc, *(x[~spot] for x in columns[:-1])) if len(at) else (at, at)
                if len(begin):
                    near = np.searchsorted(begin, at, side="right") - 1
                    inside = (near >= 0) & (at + WINDOW_WORDS <= begin[near] + size[near])
                    key = key[~inside]
                keys.append(key)
            yield pa.record_batch([pa.array(np.unique(np.concatenate(keys)))], names=["key"])

    return both.mapInArrow(outside, "key long").distinct()


def shared_windows(docs: DataFrame, places: DataFrame, keys: DataFrame, narrow: bool) -> DataFrame:
    """The windows (id and UNIT) that smaller documents hold too, near the anchors (id, key) whose key is in keys."""
    met = may_match(places.select("id", "key"), "key", keys, "key").join(keys, "key", "left_semi")
    wanted = cut(met.groupBy("id").agg(F.collect_set("key").alias("keys")))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, sought = np.array(batch.column("id"), dtype=np.int64), list(arrays(batch.column("keys")))
            for chunk in chunks(_texts(batch)):
                windows, spans, chosen = anchors(chunk, chunk.words())
                n = len(windows)
                near = [np.empty(0, dtype=np.int64)]
                bounds = np.searchsorted(spans, chunk.edges)
                for doc, (a, b) in enumerate(itertools.pairwise(bounds.tolist()), chunk.first):
                    near.append(spans[a:b][np.isin(windows[chosen[a:b]].view(np.int64), sought[doc])])
                near = np.concatenate(near)
                mine = chunk.owner[near]
                steps = np.zeros(n + 1, dtype=np.int64)
                np.add.at(steps, np.maximum(near - MARGIN, chunk.edges[mine]), 1)
                np.add.at(steps, np.minimum(near + ANCHOR_SPAN + MARGIN, chunk.edges[mine + 1] - WINDOW_WORDS + 1), -1)
                at = np.flatnonzero(np.cumsum(steps[:-1]))
                mine = chunk.owner[at]
                yield pa.record_batch(
                    [pa.array(ids[chunk.first + mine]), pa.array((at - chunk.edges[mine]).astype(np.int32)), _long(windows[at])],
                    names=["id", "start", "key"],
                )

    near = may_match(_documents(docs), "id", wanted).join(wanted, "id").select("id", "text", "keys")
    found = cut(near.mapInArrow(spread, "id long, start int, key long"))
    owner, at = _place("first", narrow)
    size = F.lit(WINDOW_WORDS)
    held = with_group(found, "key", "id", [_first_place("id", narrow).alias("first"), F.max("id").alias("hi")], owner < F.col("hi"))
    return held.where(owner < F.col("id")).select("id", "start", size.alias("words"), owner.alias("owner"), at.alias("at"), size.alias("at_words"))


#: A repeated unit: where it is in its document, and where it is in its owner.
UNIT = ("start", "words", "owner", "at", "at_words")


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the stretches that intervals cover."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.append(True, start[1:] > end[:-1])[: len(start)])
    return start[first], end[np.append(first[1:], len(start))[: len(first)] - 1]


def segments(start: np.ndarray, words: np.ndarray, owner: np.ndarray, at: np.ndarray, at_words: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(owner, start, end, at, at's end) of units that follow each other without a gap, at one distance from their places in one owner."""
    start, at = start.astype(np.int64), at.astype(np.int64)
    end, at_end, shift = start + words, at + at_words, at - start
    order = np.lexsort((start, shift, owner))
    owner, shift, start, end, at, at_end = (x[order] for x in (owner, shift, start, end, at, at_end))
    turn = np.append(True, (owner[1:] != owner[:-1]) | (shift[1:] != shift[:-1]))[: len(start)]
    # Ends so far in the group: groups are told apart by a step that no text's length reaches.
    step = np.cumsum(turn) << 40
    reach = np.maximum.accumulate(end + step) - step
    first = np.flatnonzero(turn | np.append(True, start[1:] > reach[:-1])[: len(start)])
    if len(first):
        last = np.append(first[1:], len(start)) - 1
        yield from zip(*(x.tolist() for x in (owner[first], start[first], reach[last], at[first], np.maximum.reduceat(at_end, first))), strict=True)


def _near_copy(chain: list[tuple[int, int, int, int]]) -> list[list[tuple[int, int, int, int]]]:
    """A chain of segments (start, end, at, at's end), cut at its widest gaps until what is between them is few enough edits for PERCENT."""
    done, todo = [], [chain]
    while todo:
        one = todo.pop()
        gaps, reach, at_reach, held = [0], one[0][1], one[0][3], one[0][1] - one[0][0]
        for start, end, at, at_end in one[1:]:
            gaps.append(max(0, start - reach, at - at_reach))
            held += max(0, end - max(start, reach))
            reach, at_reach = max(reach, end), max(at_reach, at_end)
        if 100 * sum(gaps) <= (100 - PERCENT) * (held + sum(gaps)):
            done.append(one)
        else:
            widest = gaps.index(max(gaps))
            todo += [one[:widest], one[widest:]]
    return done


def _by_document(batches: Iterator[pa.RecordBatch], names: tuple[str, ...] = UNIT) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(document, columns of those names) of each document, from rows (id and they) in the order of their ids."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", *names)]
        turns = np.flatnonzero(np.diff(rows[0])) + 1
        for a, b in itertools.pairwise([0, *turns.tolist(), len(rows[0])] if len(rows[0]) else []):
            if held and held[0][0][0] != rows[0][a]:
                yield int(held[0][0][0]), [np.concatenate(x) for x in list(zip(*held, strict=True))[1:]]
                held = []
            held.append([x[a:b] for x in rows])
    if held:
        yield int(held[0][0][0]), [np.concatenate(x) for x in list(zip(*held, strict=True))[1:]]


def joined(start: np.ndarray, words: np.ndarray, owner: np.ndarray, at: np.ndarray, at_words: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(start, words, owner, place in the owner, words there) of the passages that one document's units of other owners add up to.

    A passage shorter than PASSAGE_WORDS counts only where it overlaps one that counts by all of a window but a word.
    """
    if not len(start) or int((start + words).max()) - int(start.min()) < PASSAGE_WORDS:
        return []
    chains: list[list] = []  # owner, reach, place of the last segment, reach in the owner, segments
    live: list[list] = []
    for own, begin, end, place, place_end in sorted(segments(start, words, owner, at, at_words)):
        live = [c for c in live if c[0] == own and begin <= c[1] + BRIDGE_WORDS]
        for c in reversed(live):
            if c[2] <= place <= c[3] + BRIDGE_WORDS and place_end >= c[3] - BRIDGE_WORDS:
                c[1], c[2], c[3] = max(c[1], end), place, max(c[3], place_end)
                c[4].append((begin, end, place, place_end))
                break
        else:
            live.append([own, end, place, place_end, [(begin, end, place, place_end)]])
            chains.append(live[-1])
    found, rest = [], []
    for own, *_, chain in chains:
        for one in _near_copy(chain):
            a, b = one[0][0], max(x[1] for x in one)
            first, last = min(x[2] for x in one), max(x[3] for x in one)
            (found if b - a >= PASSAGE_WORDS else rest).append((a, b - a, own, first, last - first))
    # Where a longer passage of a later owner holds a part of an earlier one, the rest of it is shorter.  Its first window
    # reaches back into the part.
    begins, ends = merged(*(np.array(x, dtype=np.int64) for x in ([f[0] for f in found], [f[0] + f[1] for f in found])))
    while rest and len(begins):
        near = [any(min(a + n, e) - max(a, b) >= WINDOW_WORDS - 1 for b, e in zip(begins, ends, strict=True)) for a, n, *_ in rest]
        if not any(near):
            break
        new = [x for x, yes in zip(rest, near, strict=True) if yes]
        rest = [x for x, yes in zip(rest, near, strict=True) if not yes]
        found += new
        begins, ends = merged(np.append(begins, [x[0] for x in new]), np.append(ends, [x[0] + x[1] for x in new]))
    return found


def covered(doc: int, start: np.ndarray, words: np.ndarray, owner: np.ndarray, at: np.ndarray, at_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, words) of the stretches of a document that passages hold; of what it owns itself, all units that touch."""
    other = owner != doc
    spans = [(a, a + n) for a, n, *_ in joined(*(x[other] for x in (start, words, owner, at, at_words)))]
    own_start, own_end = merged(start[~other].astype(np.int64), (start + words)[~other].astype(np.int64))
    long = own_end - own_start >= PASSAGE_WORDS
    both = np.array(spans, dtype=np.int64).reshape(-1, 2)
    begin, end = merged(np.concatenate([both[:, 0], own_start[long]]), np.concatenate([both[:, 1], own_end[long]]))
    return begin, end - begin


@tidy
def passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, n_words, first_doc_id, removed): repeated passages.

    A row for each passage that repeats in other documents: removed is true in the documents that
    lose it, and false for the stretches that the smallest documents keep in their stead.  Rows that share
    a doc_id are one document.  Rows with a null doc_id, and null, empty or short texts, give none.  Very long texts are
    read whole; an empty table gives no rows.
    """
    found = cut(units(docs))
    postings = found.select("id", "start", "words", "key", F.size("buckets").alias("n_buckets"), F.explode("buckets").alias("bucket"))
    bounds = [F.min("id").alias("lo"), F.max("id").alias("hi"), salts("id").alias("held")]
    shared = cut(postings.groupBy("bucket").agg(*bounds).where("lo < hi").select(F.col("bucket").alias("s_bucket"), "held"))
    dealt = shared.select(F.col("s_bucket").alias("bucket"), each_salt("held").alias("salt"))
    met = may_match(postings, "bucket", shared, "s_bucket").withColumn("salt", salt("id"))
    met = cut(met.join(dealt, ["bucket", "salt"], "left_semi").drop("salt"))
    discard(found)
    discard(shared)
    whole = met.where("words > 0")
    labels = unit_components(docs, whole.where(F.col("words") >= BANDED_WORDS))
    narrow = _narrow(docs)
    doc, start = _place("lo", narrow)
    # Units of one key are of one length.
    named = linking.with_component(whole.withColumnRenamed("id", "doc").groupBy(F.col("key").alias("id")).agg(
        _first_place("doc", narrow).alias("lo"), F.min("words").alias("words"), F.max("doc").alias("hi"), salts("doc").alias("held")
    ), labels).withColumn("lo", F.struct(doc.alias("doc"), start.alias("start"), "words"))
    first = named.groupBy("component").agg(F.min("lo").alias("first"), F.max("hi").alias("hi")).where("first.doc < hi")
    owners = named.join(first.select("component", "first"), "component").select(
        F.col("id").alias("key"), "words", F.col("first.doc").alias("owner"), F.col("first.start").alias("at"), F.col("first.words").alias("at_words"), each_salt("held").alias("salt")
    )
    # A unit is in several buckets: its rows are made one where they meet its owner.
    unit_rows = whole.select("id", "start", "key", salt("id").alias("salt")).repartition("key", "salt").distinct()
    held = cut(unit_rows.join(owners, ["key", "salt"]).select("id", *UNIT))
    places = met.where("words = 0").select("id", "start", "key")
    held = held.union(shared_windows(docs, places, cut(uncovered(places, held)), narrow))
    # Sorted rows, not lists: what collects lists sorts as well, before and after the shuffle.
    runs = held.where("owner <> id").select("id", *UNIT).repartition("id").sortWithinPartitions("id")

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in itertools.batched(_by_document(batches), 400):
            rows = [(doc, *passage) for doc, unit in some for passage in joined(*unit)]
            columns = np.array(rows, dtype=np.int64).reshape(-1, 6).T
            yield pa.record_batch([pa.array(c) for c in columns], names=["doc_id", *UNIT])

    gone = cut(runs.mapInArrow(join_up, "doc_id long, start long, words long, owner long, at long, at_words long"))
    by_start = Window.partitionBy("owner").orderBy("at", "until")
    kept = gone.select("owner", "at", (F.col("at") + F.col("at_words")).alias("until")).distinct()
    kept = kept.withColumn("reach", F.max("until").over(by_start.rowsBetween(Window.unboundedPreceding, -1)))
    kept = kept.withColumn("run", F.sum(F.when(F.col("at") <= F.col("reach"), 0).otherwise(1)).over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    kept = kept.groupBy("owner", "run").agg(F.min("at").alias("at"), F.max("until").alias("until"))
    return gone.select(
        "doc_id", F.col("start").cast("int").alias("start_word"), F.col("words").cast("int").alias("n_words"), F.col("owner").alias("first_doc_id"), F.lit(True).alias("removed")
    ).union(
        kept.select("owner", F.col("at").cast("int"), (F.col("until") - F.col("at")).cast("int"), F.col("owner"), F.lit(False))
    )


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without runs of words (start, n): each goes up to the next word; what is before it stays as it is."""
    data = text.encode()
    starts, _ = word_spans(data)
    parts, at = [], 0
    for start, n in sorted(spans):
        begin = int(starts[start]) if start < len(starts) else len(data)
        parts.append(data[at:begin] if begin > at else b"")
        at = max(at, int(starts[start + n]) if start + n < len(starts) else len(data))
    return (b"".join(parts) + data[at:]).decode()


def remove_passages(docs: DataFrame) -> DataFrame:
    """docs without the repeated passages, with their own columns; n_chars, if there is one, is counted anew.

    A document that had words and has none left goes.  Only texts with something to
    remove are joined.
    """
    spans = cut(
        passages(docs.select("doc_id", "text"))
        .where("removed")
        .groupBy(F.col("doc_id").alias("tm_id"))
        .agg(F.collect_list(F.struct("start_word", "n_words")).alias("tm_spans"))
    )
    hit = fresh(docs, "hit")
    marked = may_match(docs, "doc_id", spans, "tm_id", flag=hit)
    unsure = marked.where(F.col(hit)).drop(hit)
    own = docs.columns
    joined = unsure.join(spans, unsure["doc_id"] == spans["tm_id"], "left")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [
                without(t, [(s["start_word"], s["n_words"]) for s in spans]) if t and spans else t
                for t, spans in zip(batch.column("tm_new").to_pylist(), batch.column("tm_spans").to_pylist(), strict=True)
            ]
            at = batch.schema.get_field_index("tm_new")
            yield batch.set_column(at, "tm_new", pa.array(texts, type=pa.string()))

    packed = joined.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col("text").alias("tm_new"), "tm_spans")
    cleaned = packed.mapInArrow(strip, packed.schema)
    cleaned = cleaned.where(F.col("tm_spans").isNull() | F.col("tm_new").rlike(r"[^\x20\x09-\x0D]"))

    def value(c: str):
        if c == "text":
            return F.col("tm_new").alias(c)
        if c == "n_chars":
            kind = dict(docs.dtypes)[c]
            return F.when(F.col("tm_spans").isNull(), F.col("row").getField(c)).otherwise(F.char_length("tm_new")).cast(kind).alias(c)
        return F.col("row").getField(c).alias(c)

    return marked.where(~F.col(hit)).drop(hit).unionByName(cleaned.select(*map(value, own)))
