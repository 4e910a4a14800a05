"""Joins and windows over time: as-of, bands, intervals, carried state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def band_pairs(rows: DataFrame, key: str, time: str, ident: str, seconds: int) -> DataFrame:
    """Pairs of rows of one key at most ``seconds`` apart.

    The time axis is cut into cells of that width and a row meets its own and the next cell, so the
    join is an equi-join on (key, cell) and no key is paired with all of itself.
    """
    at = F.unix_timestamp(F.col(time).cast("timestamp"))
    base = rows.select(F.col(key).alias("k"), F.col(ident).alias("i"), at.alias("t"), F.floor(at / seconds).alias("cell"))
    left = base.select("k", F.col("i").alias("a"), F.col("t").alias("ta"), F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    right = base.select("k", F.col("i").alias("b"), F.col("t").alias("tb"), "cell")
    pairs = left.join(right, ["k", "cell"]).where(F.abs(F.col("ta") - F.col("tb")) <= seconds)
    return pairs.where("a < b").select("a", "b", F.col("k").alias(key), F.abs(F.col("ta") - F.col("tb")).alias("seconds_apart"))


def union_seconds(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, n_islands, seconds): the length of the union of intervals, by gaps and islands."""
    order = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("opens", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    islands = marked.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    each = islands.groupBy(key, "island").agg(F.min(start).alias("s"), F.max(end).alias("e"))
    return each.groupBy(key).agg(F.count("*").alias("n_islands"), F.sum(F.col("e") - F.col("s")).alias("seconds"))
