"""Severity, risk matrices and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metric weights of CVSS v3.1.
CVSS_WEIGHTS = {
    "av": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2},
    "ac": {"L": 0.77, "H": 0.44},
    "ui": {"N": 0.85, "R": 0.62},
    "impact": {"H": 0.56, "L": 0.22, "N": 0.0},
}


def _weight(c: Column, table: dict[str, float]) -> Column:
    found = None
    for k, v in table.items():
        found = F.when(c == k, v) if found is None else found.when(c == k, v)
    return found


def cvss31_base(rows: DataFrame) -> DataFrame:
    """vector columns av ac pr ui s c i a, with base_score: the published formula with its rounding up to tenths."""
    changed = F.col("s") == "C"
    pr = (
        F.when(F.col("pr") == "N", 0.85)
        .when((F.col("pr") == "L") & changed, 0.68)
        .when(F.col("pr") == "L", 0.62)
        .when(changed, 0.5)
        .otherwise(0.27)
    )
    one_less = lambda c: 1 - _weight(F.col(c), CVSS_WEIGHTS["impact"])
    iss = 1 - one_less("c") * one_less("i") * one_less("a")
    impact = F.when(changed, 7.52 * (iss - 0.029) - 3.25 * F.pow(iss - 0.02, F.lit(15.0))).otherwise(6.42 * iss)
    ease = 8.22 * _weight(F.col("av"), CVSS_WEIGHTS["av"]) * _weight(F.col("ac"), CVSS_WEIGHTS["ac"]) * pr * _weight(F.col("ui"), CVSS_WEIGHTS["ui"])
    raw = F.least(F.when(changed, 1.08 * (impact + ease)).otherwise(impact + ease), F.lit(10.0))
    scaled = F.round(raw * 100000).cast("long")
    up = F.when(scaled % 10000 == 0, scaled / 100000.0).otherwise((F.floor(scaled / 10000) + 1) / 10.0)
    return rows.withColumn("base_score", F.when(impact <= 0, 0.0).otherwise(up))


def band(score: Column) -> Column:
    """Severity of a 0 .. 10 score."""
    return (
        F.when(score >= 9.0, "critical").when(score >= 7.0, "high").when(score >= 4.0, "medium").when(score > 0.0, "low").otherwise("none")
    )
