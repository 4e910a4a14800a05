"""What kind of file a text is, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bytes that are sniffed, lines that are looked at, the longest middle line and the most semicolons a line of code that
# people wrote, marks and paths of generated files, and folders of other people's code.
SNIFFED = 8192
SAMPLED, MARKED = 200, 5
MIDDLE_LINE, SEMICOLONS = 500, 5
MINIFIED_NAMES = r"(?i)(?:\.min\.(?:js|css)|-min\.js)$"
GENERATED_MARKS = ("@generated", "Code generated by", "DO NOT EDIT", "Autogenerated")
GENERATED_PATHS = r"_pb2\.py$|\.pb\.go$|\.g\.dart$|_generated\.[^/]+$|(?:^|/)migrations/"
VENDORED = ("vendor", "third_party", "node_modules", "Godeps", ".venv", "site-packages")


def is_binary(content: Column) -> Column:
    """Whether there is a zero byte near the beginning."""
    return F.locate("\x00", F.substring(content, 1, SNIFFED).cast("string")) > 0


def is_minified(path: Column, text: Column) -> Column:
    """By its name, by the middle one of its first lines, or by its semicolons a line."""
    lengths = F.array_sort(F.transform(F.slice(F.split(text, "\n", -1), 1, SAMPLED), F.char_length))
    middle = F.element_at(lengths, (F.floor(F.size(lengths) / 2) + 1).cast("int"))
    lines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + F.when(text.endswith("\n") | (text == ""), 0).otherwise(1)
    marks = F.char_length(text) - F.char_length(F.replace(text, F.lit(";"), F.lit("")))
    return path.rlike(MINIFIED_NAMES) | (middle > MIDDLE_LINE) | ((lines > 0) & (marks > SEMICOLONS * lines))


def is_generated(path: Column, text: Column) -> Column:
    """By a mark in its first lines, or by its path."""
    head = F.slice(F.split(text, "\n", -1), 1, MARKED)
    return path.rlike(GENERATED_PATHS) | F.exists(head, lambda x: x.rlike("|".join(GENERATED_MARKS)))


def is_vendored(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, VENDORED)))
