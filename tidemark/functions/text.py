"""Column functions over text: detectors' patterns, entropy, check digits, normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns without look-around, so that they mean the same in Java and RE2.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IPV4 = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}"
DIGIT_RUN = r"[0-9]{13,19}"
LOCAL_NUMBER = r"555-[0-9]{4}"
ASSIGNED_TOKEN = r"([A-Za-z_]+) *= *\"([0-9a-f]{32,64})\""
LICENCE_LINE = r"(?i)licen[cs]ed? |copyright|all rights reserved"
TAG = r"<[^>]*>"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def shannon_entropy(token: Column) -> Column:
    """Bits a character; 0 for an empty token."""
    chars = F.split(token, "")
    size = F.char_length(token)
    shares = F.transform(
        F.array_distinct(chars),
        lambda c: F.size(F.filter(chars, lambda x: x == c)) / size,
    )
    return F.coalesce(F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p)), F.lit(0.0))


def luhn_valid(digits: Column) -> Column:
    """The check digit rule of card numbers: every second digit from the right is doubled."""
    reverse = F.split(F.reverse(digits), "")
    doubled = F.transform(
        reverse,
        lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def fingerprint(*parts: Column) -> Column:
    """A stable name of a finding: the SHA-256 of its parts, with a separator that they don't hold."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def normal_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\x0b\f\r]+", " "))
