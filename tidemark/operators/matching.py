"""Nearest matches, greedy folds, resampling and substring search."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_before(left: DataFrame, right: DataFrame, key: str, time: str, ident: str, seconds: int, within: str | None = None, outer: bool = False) -> DataFrame:
    """(left_id, right_id): for each left row the last right row of its key at or before it, at most ``seconds`` away; with ``outer`` null where there is none.

    Both sides are sorted once by key and time and the last right row is carried forward: no pair is built.
    Of right rows at one time the one with the greatest ``within`` counts, of equals the smallest id.
    """
    last = F.min(ident) if within is None else F.max_by(ident, F.struct(within, -F.col(ident)))
    first = right.dropna(subset=[key, time]).groupBy(key, time).agg(last.alias("right_id"))
    rows = left.select(key, time, F.col(ident).alias("left_id"), F.lit(None).cast("long").alias("right_id")).unionByName(
        first.select(key, time, F.lit(None).cast("long").alias("left_id"), "right_id")
    )
    order = Window.partitionBy(key).orderBy(time, F.col("right_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("right_id").isNotNull(), F.struct("right_id", time))
    carried = rows.withColumn("seen", F.last(mark, ignorenulls=True).over(order)).where("left_id is not null")
    found = carried.select("left_id", F.when(F.col(time) - F.col("seen")[time] <= seconds, F.col("seen.right_id")).alias("right_id"))
    return found if outer else found.where("right_id is not null")


def greedy_fold(rows: DataFrame, key: str, time: str, ident: str, seconds: int) -> DataFrame:
    """(id, group_id): rows in time order join the open group of their key while they are near its first row.

    The fold depends on its own earlier decisions, so a window can't express it: rows are sorted and streamed through a state of one
    group.  A gap of more than ``seconds`` always begins a group, so a key is cut at its gaps first, which cells of that width show, and
    what a task streams is a stretch without a gap and not a key.
    """
    sized = rows.select(F.col(key).alias("k"), F.col(time).alias("t"), F.col(ident).alias("i"), F.floor(F.col(time) / seconds).alias("cell"))
    cells = sized.groupBy("k", "cell").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    order = Window.partitionBy("k").orderBy("cell")
    gap = F.when(F.col("first") - F.lag("last").over(order) > seconds, 1).otherwise(0)
    stretch = F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("stretch")
    named = cells.withColumn("gap", gap).select(F.col("k").alias("of"), F.col("cell").alias("at"), stretch)
    sized = sized.join(named, F.col("k").eqNullSafe(F.col("of")) & (F.col("cell") == F.col("at"))).select("k", "stretch", "t", "i")

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = start = group = None
        for part in parts:
            out = []
            for k, s, t, i in part.itertuples(index=False, name=None):
                if (k, s) != now or t - start > seconds:
                    now, start, group = (k, s), t, i
                out.append((i, group))
            yield pd.DataFrame(out, columns=["id", "group_id"])

    return sized.repartition("k", "stretch").sortWithinPartitions("k", "stretch", "t", "i").mapInPandas(fold, "id long, group_id long")


def poisson_bootstrap(rows: DataFrame, ident: str, flag: str, resamples: int, seed: int = 17) -> DataFrame:
    """(mean, low, high): each resample weights each row by a Poisson(1) draw of a hash, in one pass and one aggregate."""
    # Cumulative probabilities of 0, 1, 2 ... in a Poisson distribution of mean 1.
    steps, p, total = [], 0.36787944117144233, 0.0
    for k in range(1, 10):
        total += p
        steps.append(total)
        p /= k
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("r"), ident), F.lit(1 << 30)) / float(1 << 30)
    weight = sum((F.when(u >= s, 1).otherwise(0) for s in steps), F.lit(0))
    drawn = rows.select(ident, flag, F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("r")).withColumn("w", weight)
    means = drawn.groupBy("r").agg((F.sum(F.col("w") * F.col(flag)) / F.sum("w")).alias("m"))
    return means.agg(
        F.round(F.avg("m"), 6).alias("mean"),
        F.round(F.percentile("m", F.lit(0.025)), 6).alias("low"),
        F.round(F.percentile("m", F.lit(0.975)), 6).alias("high"),
    )


#: Canaries that a text is searched for in one row.
ITEM_BLOCK = 1000


def substring_counts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, exposed_in): documents that contain items' canary strings.

    Inner words of a canary are whole words of any text that holds it.  The first two of them (one, if the canary has
    three words) meet the documents' distinct word pairs and words, and only what meets is checked.  A canary of one or two words
    has no inner word: texts are searched for those, a block of ITEM_BLOCK canaries at a time.
    """
    parts = F.split("canary", " ")
    keys = items.where(F.size(parts) >= 3).select(
        "item_id", "canary", F.array_join(F.slice(parts, 2, F.least(F.lit(2), F.size(parts) - 2)), " ").alias("g")
    )
    split = docs.select("doc_id", "text", F.split("text", " ").alias("w"))
    n = F.size("w")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, 2), " "))
    grams = split.select("doc_id", F.explode(F.array_distinct(F.concat("w", pairs))).alias("g"))
    # Texts stay behind: ids alone meet the keys, and the few documents that do are joined for the check.
    met = grams.join(keys, "g").select("doc_id", "item_id", "canary").distinct()
    met = met.join(docs.select("doc_id", "text"), "doc_id").where(F.col("text").contains(F.col("canary")))
    short = items.where(F.size(parts) < 3).select("item_id", "canary")
    block = short.groupBy(F.pmod(F.xxhash64("item_id"), F.ceil(F.lit(short.count()) / ITEM_BLOCK)).alias("block")).agg(
        F.collect_list(F.struct("item_id", "canary")).alias("block_items")
    )
    searched = docs.select("doc_id", "text").crossJoin(F.broadcast(block.select("block_items")))
    hits = F.filter("block_items", lambda x: F.col("text").contains(x["canary"]))
    searched = searched.select("doc_id", F.explode(hits).alias("hit")).select("doc_id", "hit.item_id")
    counts = met.select("doc_id", "item_id").union(searched).groupBy("item_id").agg(F.count_distinct("doc_id").alias("n"))
    return items.join(counts, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("exposed_in"))
