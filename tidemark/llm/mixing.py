"""Mixing sources to target weights.

The texts of a source, one after another, are packed into blocks of a fixed number of words.  A source is drawn as
many blocks as its target asks for.  How many of them each output shard takes is drawn from a multinomial
distribution: first for groups of shards, then for the shards of each group, so no task holds all shards.  A shard's
counts are therefore multinomial given the sources' totals; an unconditional draw would pass the cap of the sources that
are at it.  Running sums of the counts number the slots of a source.  A slot goes through a pseudorandom permutation
of its source's blocks, one for each pass over the source, and blocks are joined by that index.  A source of n blocks is
passed ceil(draws / n) times, so no block is used more often than that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.frames import cut, same, slices
from tidemark.llm.quality import word_array
from tidemark.llm.textkit import mix

#: Words of a block, and of an output shard on average.
BLOCK_WORDS = 64
SHARD_WORDS = 1 << 22
#: The weights of the sources in code point order, repeating; the mix's words as a part of all; the most passes.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_PASSES = 2
SEED = 20240
#: Rows of a part of a source, about: running sums are taken inside parts and over parts.
PART_ROWS = 20_000
#: Shards whose counts are drawn by one row.
GROUP_SHARDS = 16
#: Draws that a task makes, about.
TASK_DRAWS = 1 << 20


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a keyed permutation of 0 .. n - 1 sends index: a Feistel network, walked until it is below n."""
    bits = np.ceil(np.log2(np.maximum(n, 2).astype(np.float64) + 1))
    half = np.maximum(1, np.ceil(bits / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    value = index.astype(np.uint64)
    todo = np.arange(len(value))
    key = key.astype(np.int64).view(np.uint64)
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = value[todo] >> h, value[todo] & m
        for r in range(6):
            x = (right + np.uint64(r * 0x9E3779B97F4A7C15 % (1 << 64))) ^ k
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((x ^ (x >> np.uint64(32))) & m)
        value[todo] = (left << h) | right
        todo = todo[value[todo] >= n[todo].astype(np.uint64)]
    return value.astype(np.int64)


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_PASSES
) -> DataFrame:
    """(source, source_size, target): the words a source should give, from (source, size).

    Water filling: sources in order of most * size / weight fill up first, and the level
    that the others reach is the highest that any number of full sources leaves.  The windows
    run over one row a source.
    """
    sums = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    ranked = sums.withColumn("i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("i") % len(weights) + 1).cast("int"))
    full = ranked.withColumn("w", weight.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    before = Window.orderBy(F.col("cap") / F.col("w"), "i").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0.0)
    levels = full.withColumn(
        "level",
        (F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("cap").over(before), zero))
        / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), zero)),
    )
    return levels.select(
        "source",
        "source_size",
        F.least("cap", F.col("w") * F.greatest(F.max("level").over(whole), zero)).alias("target"),
    )


def sized_rows(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, named, size, h, ...): named is the source as a key that is never null."""
    return docs.select(
        "doc_id",
        "source",
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("named"),
        F.size(word_array(F.coalesce("text", F.lit("")))).cast("long").alias("size"),
        F.xxhash64("doc_id", "text").alias("h"),
        *extra,
    )


def placed_rows(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """rows with ``at``: the words of the same source before each.  Both are sized_rows of one table.

    The order in a source is by hash.  Running sums are taken inside parts of a source and over the parts, so a task
    holds a part's rows, or one row for each part of a source: a row for 20,000 documents.  Rows cross one exchange.
    """
    parts = max(16, -(-sizes.count() // PART_ROWS))
    part = F.pmod("h", F.lit(parts)).alias("part")
    over = Window.partitionBy("named").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = (
        sizes.groupBy("named", part)
        .agg(F.sum("size").alias("s"))
        .select("named", "part", F.coalesce(F.sum("s").over(over), F.lit(0)).alias("ahead"))
    )
    inside = Window.partitionBy("named", "part").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.withColumn("part", part).join(ahead, ["named", "part"])
    return joined.withColumn("at", F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0))).drop("part", "ahead", "h")


def draws(targets: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """(source, named, shard, slot, pass, block): a row for each block that the mix takes."""
    n = F.ceil(F.col("source_size") / block_words).cast("long")
    sized = targets.where("source_size > 0").select(
        "source",
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("named"),
        n.alias("n"),
        F.round(F.col("target") / F.col("source_size") * n).cast("long").alias("draws"),
        F.xxhash64(F.lit(seed), "source").alias("key"),
        "target",
    )
    words, total = sized.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.coalesce(F.sum("draws"), F.lit(0))).first()
    shards = max(1, int(-(-words // shard_words)))

    def chance(key: int, turn: int) -> np.random.Generator:
        """A generator that depends on the seed, the source and the group of shards alone."""
        return np.random.Generator(np.random.Philox(key=[key % (1 << 64), turn]))

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.arange(0, shards, GROUP_SHARDS)
        sizes = np.minimum(first + GROUP_SHARDS, shards) - first
        for batch in slices(batches, 1):  # one source
            if not batch.num_rows:
                continue
            row = batch.to_pylist()[0]
            counts = chance(row["key"], 0).multinomial(row["draws"], sizes / shards)
            starts = np.cumsum(counts) - counts
            same = pa.array(np.zeros(len(first), dtype=np.int64))
            yield pa.record_batch(
                [*(batch.column(c).take(same) for c in ("source", "named", "n", "key")), *map(pa.array, (first, sizes, starts, counts))],
                names=["source", "named", "n", "key", "first", "shards", "start", "count"],
            )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):  # one source and group of shards
            if not batch.num_rows:
                continue
            row = batch.to_pylist()[0]
            counts = chance(row["key"], row["first"] + 1).multinomial(row["count"], np.full(row["shards"], 1 / row["shards"]))
            start = row["start"]
            for shard, count in enumerate(counts.tolist(), row["first"]):
                slot = np.arange(start, start + count)
                start += count
                turn = slot // row["n"]
                keys = mix(np.uint64(row["key"] % (1 << 64)) + turn.astype(np.uint64) + np.uint64(1)).view(np.int64)
                block = permuted(slot - turn * row["n"], np.full(count, row["n"]), keys)
                same = pa.array(np.zeros(count, dtype=np.int64))
                yield pa.record_batch(
                    [*(batch.column(c).take(same) for c in ("source", "named")), *map(pa.array, (np.full(count, shard), slot, turn, block))],
                    names=["source", "named", "shard", "slot", "pass", "block"],
                )

    grouped = sized.where("draws > 0").select("source", "named", "n", "draws", "key").mapInArrow(
        groups, "source string, named string, n long, key long, first long, shards long, start long, count long"
    )
    tasks = min(max(1, -(-int(total) // TASK_DRAWS)) * 2, 20_000)
    return grouped.repartition(tasks, "named", "first").mapInArrow(
        deal, "source string, named string, shard long, slot long, pass long, block long"
    )


def _blocks(block_words: int) -> Column:
    """Indices of the blocks that a row of at, size reaches into."""
    last = F.floor((F.col("at") + F.col("size") - 1) / block_words)
    return F.sequence(F.floor(F.col("at") / block_words).cast("long"), last.cast("long"))


def mixed_words(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs.

    A null text has size 0; a null source is a source of its own, the last.  Rows without
    words are taken no words of.  Repeated rows are rows of their own.  The order in a source
    and the draws are hashes, so reruns agree.  An empty table gives no rows.
    """
    sizes = cut(sized_rows(docs))
    targets = cut(source_targets(sizes))
    rows = placed_rows(sizes, sizes).where("size > 0")
    start = F.col("block") * block_words
    parts = rows.select("doc_id", "source", "named", "at", "size", F.explode(_blocks(block_words)).alias("block")).withColumn(
        "words", F.least(F.col("at") + F.col("size"), start + block_words) - F.greatest("at", start)
    )
    used = draws(targets, block_words, shard_words, seed).groupBy("named", "block").agg(F.count("*").alias("times"))
    # Draws come from one row a source, which the planner takes for their size.
    taken = (
        parts.join(used.hint("merge"), ["named", "block"], "left")
        .groupBy("named", "at", "doc_id", "source", "size")
        .agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
        .select("doc_id", "source", "size", "taken")
    )
    bare = sizes.where("size = 0").select("doc_id", "source", "size", F.lit(0).cast("long").alias("taken"))
    t = targets.withColumnRenamed("source", "g_source")
    return (
        taken.union(bare)
        .join(t, same(F.col("source"), F.col("g_source")))
        .select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))
    )


def mixed_blocks(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """(shard, slot, source, pass, block, n_words, doc_ids, text): the mix itself.

    A block's words are joined by one space.  A source's last block may be shorter.  A null text has no words and is in
    no block; a null source is a source of its own; repeated rows are rows of their own, as in mixed_words; other columns
    of docs don't matter.  An empty table gives no rows.  Texts are exchanged by source and part, where they are cut, and
    once more as blocks, by block: draws meet them there, a row for each block.
    """
    sizes = cut(sized_rows(docs))
    targets = cut(source_targets(sizes))
    rows = placed_rows(sized_rows(docs, ("text",)).where("size > 0"), sizes).withColumn("words", word_array(F.col("text")))
    start = lambda j: F.greatest(j * block_words - F.col("at"), F.lit(0))
    end = lambda j: F.least((j + 1) * block_words - F.col("at"), F.size("words"))
    pieces = rows.select(
        "doc_id",
        "source",
        "named",
        "at",
        F.explode(
            F.transform(
                _blocks(block_words),
                lambda j: F.struct(
                    j.alias("block"),
                    (end(j) - start(j)).cast("int").alias("n"),
                    F.array_join(F.slice("words", (start(j) + 1).cast("int"), (end(j) - start(j)).cast("int")), " ").alias("text"),
                ),
            )
        ).alias("piece"),
    )
    blocks = (
        pieces.groupBy("named", F.col("piece.block").alias("block"))
        .agg(F.first("source").alias("source"), F.sort_array(F.collect_list(F.struct("at", "doc_id", "piece.n", "piece.text"))).alias("items"))
        .select(
            "named",
            "block",
            "source",
            F.aggregate("items.n", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_words"),
            F.col("items.doc_id").alias("doc_ids"),
            F.array_join("items.text", " ").alias("text"),
        )
    )
    places = (
        draws(targets, block_words, shard_words, seed)
        .groupBy("named", "block")
        .agg(F.collect_list(F.struct("shard", "slot", "pass")).alias("places"))  # one for each pass
        .hint("merge")
    )
    return blocks.join(places, ["named", "block"]).select(F.inline("places"), "source", "block", "n_words", "doc_ids", "text").select(
        "shard", "slot", "source", "pass", "block", "n_words", "doc_ids", "text"
    )
