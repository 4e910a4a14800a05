"""Filters that tell found values from secrets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import formats

#: The name that a value is assigned to, at the end of what is before it.
_FIELD = r"""([A-Za-z_][\w.\-]{0,63})["']?\s*(?::=|=>|[:=])\s*["'`]?$"""


def listed(found: DataFrame, placeholders: DataFrame | None) -> DataFrame:
    """found with ``listed``: whether the value, in lower case, is one of a one-column table of placeholder values."""
    if placeholders is None:
        return found.withColumn("listed", F.lit(False))
    known = placeholders.select(F.lower(placeholders.columns[0]).alias("tm_known")).distinct().withColumn("tm_yes", F.lit(True))
    return found.join(known, F.lower("value") == F.col("tm_known"), "left").withColumn("listed", F.coalesce("tm_yes", F.lit(False))).drop("tm_known", "tm_yes")


def filtered(found: DataFrame, placeholders: DataFrame | None = None) -> DataFrame:
    """Spans with ``path``, ``before``, ``after`` without those that the filters drop; ``downgraded`` where a value is only too frequent, which is then unsure.

    A value's frequency is that of all spans given.
    """
    counts = found.groupBy(F.col("value").alias("tm_value")).agg(F.count("*").alias("tm_times")).where(F.col("tm_times") > formats.REPEATS)
    counted = found.join(counts, F.col("value") == F.col("tm_value"), "left").drop("tm_value")
    line = F.concat_ws("", "before", "value", "after")
    field = F.nullif(F.regexp_extract("before", _FIELD, 1), F.lit(""))
    rule = formats.secret_filter(F.col("value"), F.coalesce("path", F.lit("")), line, field, F.coalesce("tm_times", F.lit(0)))
    marked = listed(counted, placeholders).withColumn("rule", F.when(F.col("listed"), F.coalesce(F.when(rule != "repeated_value", rule), F.lit("placeholder_value"))).otherwise(rule))
    low = F.col("rule").isNotNull()
    kept = marked.where("rule IS NULL OR rule = 'repeated_value'")
    return kept.withColumns({"downgraded": low, "confidence": F.when(low, "low").otherwise(F.col("confidence"))}).drop("tm_times", "listed", "rule")
