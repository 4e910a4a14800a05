"""Findings: detection, fingerprints, occurrences, first-wins dedup, suppression and redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T


def detect(docs: DataFrame, pattern: str, kind: str, group: int = 0) -> DataFrame:
    """(doc_id, lang, source, kind, value, ordinal): each match of a pattern."""
    hits = docs.where(F.col("text").rlike(pattern))
    return hits.select(
        "doc_id", "lang", "source", F.lit(kind).alias("kind"), F.posexplode(T.matches(F.col("text"), pattern, group)).alias("ordinal", "value")
    )


def with_fingerprint(findings: DataFrame) -> DataFrame:
    """A fingerprint of kind, source and value, and the number of the occurrence among equal ones."""
    marked = findings.withColumn("fingerprint", T.fingerprint(F.col("kind"), F.col("source"), F.col("value")))
    order = Window.partitionBy("fingerprint").orderBy("doc_id", "ordinal")
    return marked.withColumn("occurrence", F.row_number().over(order))


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row a key: the first in the order.  One sort in one shuffle; ties are broken by the order's last columns."""
    place = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("tm_place", F.row_number().over(place)).where("tm_place = 1").drop("tm_place")


def delta(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, state): new, fixed or unchanged, from the distinct keys of two runs."""
    a = old.select(key).distinct().withColumn("was", F.lit(True))
    b = new.select(key).distinct().withColumn("is", F.lit(True))
    state = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "fixed").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def redacted(text: Column) -> Column:
    """The text with addresses, numbers and tokens replaced by their kinds."""
    out = F.regexp_replace(text, T.EMAIL, "<EMAIL>")
    out = F.regexp_replace(out, T.IPV4, "<IP>")
    return F.regexp_replace(out, T.ASSIGNED_TOKEN, '$1 = "<TOKEN>"')
