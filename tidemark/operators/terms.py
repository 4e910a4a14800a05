"""Terms of a table found in texts: all overlapping hits of folded terms, and originals inside words.

A term matches in lower case and whatever separators stand inside it.  Terms go to the tasks in blocks of bounded size, one
pass over the texts a block, and each task builds one automaton from its block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.graph import stored

#: What doesn't count inside a term, and the fewest characters of a folded term.
SEPARATORS = " \t\n\r\f\v-_."
LEAST = 4
#: Bytes of terms that are sent to the tasks at once.
BLOCK = 8 << 20
#: A word: letters, digits and underscores; a character outside words.
WORD = r"[\p{L}\p{N}_]+"
OTHER = r"[^\p{L}\p{N}_]"

_DROP = dict.fromkeys(map(ord, SEPARATORS))


def folded(text: Column) -> Column:
    """Lower case without separators."""
    return F.translate(F.lower(text), SEPARATORS, "")


def _lowered(text: str) -> str:
    """Lower case of the same length: a character whose lower case is longer stays."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x) == 1 else c for c, x in ((c, c.lower()) for c in text))


def blocks(terms: DataFrame, size: int = BLOCK) -> Iterator[list[str]]:
    """The distinct values of a one-column table, in lists of about ``size`` bytes."""
    column = terms.columns[0]
    distinct = terms.where(F.col(column).isNotNull()).distinct()
    total = distinct.agg(F.sum(F.octet_length(column))).first()[0] or 0
    count = -(-total // size)
    for k in range(count):
        part = distinct.where(F.pmod(F.xxhash64(column), F.lit(count)) == k) if count > 1 else distinct
        yield [r[0] for r in part.collect()]


def automaton(values: Iterable[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for v in values:
        found.add_word(v, v)
    found.make_automaton()
    return found


def _union(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    out = parts[0] if parts else empty
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _hits(text: str, known: ahocorasick.Automaton) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of every hit, in characters of the text as it stands."""
    low = _lowered(text)
    found = list(known.iter(low.translate(_DROP)))
    if found:
        at = [i for i, c in enumerate(low) if ord(c) not in _DROP]
        for last, term in found:
            yield term, at[last - len(term) + 1], at[last] + 1


def term_hits(docs: DataFrame, ident: str, text: str, terms: DataFrame, size: int = BLOCK) -> DataFrame:
    """(ident, term, value, start, end, start_byte, end_byte): every hit of the terms (a one-column table), nested and overlapping ones too.

    Terms are folded; shorter ones than LEAST and nulls match nothing.  Null texts have no hits; repeated rows have theirs each.
    """
    schema = f"ident {docs.schema[ident].dataType.simpleString()}, term string, value string, start long, end long, start_byte long, end_byte long"
    columns = [c.split()[0] for c in schema.split(", ")]
    rows = docs.where(F.col(text).isNotNull()).select(F.col(ident).alias("ident"), F.col(text).alias("text"))
    wanted = terms.select(folded(F.col(terms.columns[0])).alias("term")).where(F.char_length("term") >= LEAST)

    def search(block: list[str]) -> DataFrame:
        def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = automaton(block)
            for part in parts:
                out = []
                for i, t in part.itertuples(index=False):
                    for term, a, b in _hits(t, known):
                        before, value = len(t[:a].encode("utf-8", "replace")), t[a:b]
                        out.append((i, term, value, a, b, before, before + len(value.encode("utf-8", "replace"))))
                yield pd.DataFrame(out, columns=columns)

        return rows.mapInPandas(find, schema)

    return _union([search(b) for b in blocks(wanted, size)], docs.sparkSession.createDataFrame([], schema))


def _counted(rows: DataFrame, values: list[str], schema: str) -> DataFrame:
    """rows (key, text) with ``hits``, ``first`` (characters before the first hit) and ``whole`` (hits that are all of the text); those without a hit go."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = automaton(values)
        for part in parts:
            out = []
            for key, t in zip(part.iloc[:, 0], part.iloc[:, 1], strict=True):
                found = [(last + 1 - len(v), last + 1) for last, v in known.iter(t)]
                if found:
                    out.append((key, len(found), min(found)[0], found.count((0, len(t)))))
            yield pd.DataFrame(out, columns=["key", "hits", "first", "whole"])

    return rows.mapInPandas(count, schema)


def original_hits(
    docs: DataFrame, ident: str, text: str, originals: DataFrame, public: DataFrame | None = None, own_words: tuple[str, ...] = (), size: int = BLOCK
) -> DataFrame:
    """(ident, hits, first): how often originals (a one-column table, in lower case) stand in the texts, and after how many characters first.

    Originals of one word are sought inside words: each distinct word of all texts is searched once.  A word of ``public`` (a one-column table) isn't
    searched, and in one of ``own_words`` only an original that is all of it counts.  Others are sought in the whole text.  ``ident`` names a row.
    Texts without a hit have no row.
    """
    kind = docs.schema[ident].dataType.simpleString()
    rows = docs.where(F.col(text).isNotNull()).select(F.col(ident).alias("ident"), F.lower(text).alias("text"))
    known = originals.select(F.col(originals.columns[0]).alias("v")).where("v <> ''")
    single = known.where(F.col("v").rlike(f"^{WORD}$"))
    words = rows.select("ident", F.explode(F.regexp_extract_all("text", F.lit(WORD), 0)).alias("word"))
    distinct = words.select("word").distinct()
    if public is not None:
        names = public.select(F.lower(public.columns[0]).alias("word")).distinct()
        distinct = distinct.join(names, "word", "left_anti")
    found: list[DataFrame] = []
    for block in blocks(single, size):
        hit = _counted(distinct.select("word", "word"), block, "key string, hits long, first long, whole long")
        own = F.col("key").isin(*own_words)
        # Written, so the planner knows its size: words with a hit are few, and others need not be shuffled by text.
        hit = stored(hit.select("key", F.when(own, F.col("whole")).otherwise(F.col("hits")).alias("hits"), F.when(own, 0).otherwise(F.col("first")).alias("first")).where("hits > 0"))
        met = words.join(hit, words["word"] == hit["key"]).groupBy("ident").agg(F.sum("hits").alias("hits"), F.collect_set(F.struct("word", "first")).alias("words"))
        # A space for each character outside words, made once a text before the join: a word then stands between two.
        spaced = F.concat(F.lit(" "), F.regexp_replace("text", OTHER, " "), F.lit(" ")).alias("spaced")
        place = F.transform("words", lambda w: F.call_function("instr", F.col("spaced"), F.concat(F.lit(" "), w["word"], F.lit(" "))) - 1 + w["first"])
        found.append(rows.select("ident", spaced).join(met, "ident").select("ident", "hits", F.array_min(place).alias("first")))
    for block in blocks(known.where(~F.col("v").rlike(f"^{WORD}$")), size):
        found.append(_counted(rows, block, f"key {kind}, hits long, first long, whole long").select(F.col("key").alias("ident"), "hits", "first"))
    every = _union(found, docs.sparkSession.createDataFrame([], f"ident {kind}, hits long, first long"))
    return every.groupBy("ident").agg(F.sum("hits").alias("hits"), F.min("first").cast("long").alias("first"))
