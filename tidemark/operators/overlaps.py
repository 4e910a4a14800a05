"""Spans of which no byte is in two.

What lies inside what is found along a sort: the furthest end so far tells whether an earlier span reaches beyond a later one.  Which span
a byte belongs to is decided in the cells between the ends of all spans of a text.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.codes import CONFIDENCES
from tidemark.operators.graph import stored

# Kinds in the order in which they win, subtypes that name no specific format, and the least bytes of a piece that is cut off.
KINDS = ("secret", "pii", "term")
BROAD = ("generic_credential", "high_entropy_string", "phone_intl")
LEAST = 4

GROUP = ("ident", "kind")
SPAN = ("kind", "subtype", "confidence", "value", "start_byte", "end_byte")


def _sure() -> Column:
    return F.array_position(F.array(*map(F.lit, CONFIDENCES)), F.col("confidence")) - 1


def _order() -> list[Column]:
    """Spans before all that lie inside them; of equal ranges the best first."""
    return [F.col("start_byte"), F.desc("end_byte"), F.desc("sure"), F.col("broad"), F.col("subtype")]


def _held(among: str) -> Column:
    """Whether one of the spans marked ``among`` holds the span and doesn't yield to it.

    A broad span yields to a surer, specific one inside it, but for secrets and equal ranges.
    """
    before = Window.partitionBy(*GROUP).orderBy(*_order()).rowsBetween(Window.unboundedPreceding, -1)
    twins = Window.partitionBy(*GROUP, "start_byte", "end_byte").orderBy(*_order()).rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("end_byte")

    def reached(which: Column) -> Column:
        return F.coalesce(F.max(F.when(F.col(among) & which, end)).over(before) >= end, F.lit(False))

    firm = reached(~F.col("broad"))
    surer = [reached(F.col("broad") & (F.col("sure") == k)) & (F.col("sure") <= k) for k in range(len(CONFIDENCES))]
    stands_out = (F.col("kind") != "secret") & ~F.col("broad")
    twin = F.coalesce(F.max(F.col(among)).over(twins), F.lit(False))
    return twin | F.when(stands_out, reduce(or_, surer, firm)).otherwise(reached(F.lit(True)))


def _outermost(spans: DataFrame) -> DataFrame:
    """The spans that no span of their kind holds.

    A span that only held ones would hold stays, so those are looked at again against what certainly stays, and then among themselves: they
    are specific, and what a specific span holds, the specific spans around it hold too.
    """
    first = spans.withColumn("every", F.lit(True)).withColumn("firm", ~_held("every"))
    again = first.withColumn("more", ~F.col("firm") & ~_held("firm"))
    return again.withColumn("more", F.col("more") & ~_held("more")).where("firm OR more").drop("every", "firm", "more")


def _cells(spans: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """A row for each span and each cell (a, b) between two neighbouring ends of any of the group's spans that lies in it."""
    group = Window.partitionBy(*by)
    ends = F.array_sort(F.array_union(F.collect_set("start_byte").over(group), F.collect_set("end_byte").over(group)))
    low = F.array_position("ends", F.col("start_byte"))
    mine = F.slice("ends", low, F.array_position("ends", F.col("end_byte")) - low + 1)
    rows = spans.withColumn("ends", ends).withColumn("ends", mine)
    return rows.select(*spans.columns, F.explode(F.arrays_zip(F.expr("slice(ends, 1, size(ends) - 1)").alias("a"), F.expr("slice(ends, 2, size(ends) - 1)").alias("b"))).alias("c")).select(*spans.columns, "c.a", "c.b")


def _stretches(cells: DataFrame, span: list[str]) -> DataFrame:
    """Neighbouring cells of one span as one row, (first, last) in place of (a, b)."""
    order = Window.partitionBy("ident", *span).orderBy("a")
    opened = cells.withColumn("new", F.when(F.lag("b").over(order) == F.col("a"), 0).otherwise(1))
    numbered = opened.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("ident", *span, "run").agg(F.min("a").alias("first"), F.max("b").alias("last")).drop("run")


def _cut(spans: DataFrame) -> DataFrame:
    """Spans with ``origin``: a span that yields to others inside it is cut around them, into pieces of at least LEAST bytes."""
    before = Window.partitionBy(*GROUP).orderBy(*_order()).rowsBetween(Window.unboundedPreceding, -1)
    inner = F.coalesce(F.max("end_byte").over(before) >= F.col("end_byte"), F.lit(False))
    marked = stored(spans.withColumn("inner", inner).withColumn("mixed", F.max("inner").over(Window.partitionBy(*GROUP))).withColumn("origin", F.col("start_byte")))
    plain = marked.where("NOT mixed").drop("inner", "mixed")
    columns = [c for c in plain.columns if c != "ident"]
    # In a cell, another span of the kind that lies inside this one takes it.
    later = Window.partitionBy(*GROUP, "a").orderBy(F.desc("start_byte"), "end_byte")
    near = F.min("end_byte").over(later.rowsBetween(Window.unboundedPreceding, -1))
    lost = F.coalesce(near <= F.col("end_byte"), F.lit(False))
    cells = _cells(marked.where("mixed").drop("inner", "mixed").repartition("ident"), GROUP).withColumn("lost", lost)
    cells = cells.withColumn("hit", F.max("lost").over(Window.partitionBy("ident", *columns)))
    pieces = _stretches(cells.where("NOT lost"), [*columns, "hit"]).where(f"NOT hit OR last - first >= {LEAST}")
    return plain.unionByName(pieces.drop("start_byte", "end_byte", "hit").withColumnsRenamed({"first": "start_byte", "last": "end_byte"}))


def without_overlaps(found: DataFrame) -> DataFrame:
    """(ident, kind, subtype, confidence, value, start_byte, end_byte): spans of which no byte is in two; ``ident`` names a text.

    Inside one kind a span in another one goes.  Secrets then win over personal data, and these over terms; among one kind the surer,
    earlier and longer span wins, and the others keep what it doesn't cover.  Nulls in ``ident`` are one text.
    """
    # Rows are dealt by text: what follows, always of one text, then needs no shuffle of its own.
    dealt = found.select("ident", *SPAN).where("end_byte > start_byte").repartition("ident")
    spans = dealt.distinct().withColumns({"sure": _sure(), "broad": F.col("subtype").isin(*BROAD)})
    pieces = _cut(_outermost(spans)).repartition("ident")
    rank = F.struct(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("k"), (-F.col("sure")).alias("s"), F.col("start_byte").alias("at"), (-F.col("end_byte")).alias("e"), F.col("subtype").alias("t"))
    span = ["kind", "subtype", "confidence", "value", "origin", "start_byte"]
    best = _cells(pieces, ("ident",)).groupBy("ident", "a", "b").agg(F.min_by(F.struct(*span), rank).alias("s")).select("ident", "a", "b", "s.*")
    won = _stretches(best, span)
    part = F.expr("make_valid_utf8(cast(substring(cast(value AS binary), cast(first - origin + 1 AS int), cast(last - first AS int)) AS string))")
    return won.select("ident", "kind", "subtype", "confidence", part.alias("value"), F.col("first").alias("start_byte"), F.col("last").alias("end_byte"))
