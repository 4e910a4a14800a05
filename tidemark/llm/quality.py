"""Quality rules: text statistics and the frequency of lines across the documents of a host.

Everything here is DataFrame expressions.  The plan explodes lines, not words: word
windows are hashed inside the row that holds the text, so only one row a distinct line
is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import cut, each_salt, fresh, may_match, salt, salts

#: The six characters that separate words.
BLANKS = " \t\n\x0b\f\r"
GAP = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: A line is boilerplate on a host if more distinct texts than this hold it, and more than one in HOST_PART of the
#: host's distinct texts: a rule that doesn't change as a large host grows.
MAX_DOCS = 25
HOST_PART = 1000
#: A document is depleted if boilerplate is more than this share (percent) of its distinct lines' words.
MAX_BOILERPLATE_PERCENT = 60


def _trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def word_array(text: Column) -> Column:
    """Words of a text; an empty array if it has none."""
    body = _trimmed(text)
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, GAP, -1))


def _normal_line(line: Column) -> Column:
    """Lower case, one space between words, every digit as 0."""
    return F.regexp_replace(F.regexp_replace(F.lower(_trimmed(line)), GAP, " "), "[0-9]", "0")


def text_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of docs, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    A null text counts as an empty one.  A window that occurs again in the same text marks
    all its words, at the first occurrence as well; windows are compared by 64-bit hash.
    """
    t, words, hashes, wins, ordered, marks = (
        fresh(docs, x) for x in ("t", "words", "hashes", "wins", "ordered", "marks")
    )
    # Each array is a column of its own projection, so that lambdas refer to a value and not to an expression.
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias(t))
    rows = rows.withColumn(words, word_array(F.col(t)))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD_CHAR))
    rows = rows.select(
        *keep,
        F.size(words).cast("long").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        (F.octet_length(t) - F.octet_length(F.regexp_replace(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.aggregate(
            F.array(lines), F.lit(0).cast("long"), lambda a, x: a + F.size(x) - F.size(F.array_distinct(x))
        ).alias("n_dup_lines"),
        F.transform(words, lambda x: F.xxhash64(x)).alias(hashes),
    )
    rows = rows.withColumn(
        wins,
        F.when(
            F.size(hashes) >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size(hashes) - WINDOW),
                lambda i: F.xxhash64(*(F.col(hashes)[i + k] for k in range(WINDOW))),
            ),
        ),
    )
    rows = rows.withColumn(
        ordered,
        F.when(
            F.size(F.array_distinct(wins)) < F.size(wins),
            F.sort_array(F.transform(wins, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        ),
    ).drop(hashes, wins)
    last = F.size(ordered) - 1
    rows = rows.withColumn(
        marks,
        F.sort_array(
            F.transform(
                F.filter(
                    ordered,
                    lambda x, k: ((k > 0) & (F.col(ordered)[F.greatest(k - 1, F.lit(0))]["h"] == x["h"]))
                    | ((k < last) & (F.col(ordered)[F.least(k + 1, last)]["h"] == x["h"])),
                ),
                lambda x: x["i"],
            )
        ),
    )
    # Marked windows overlap: each adds the words up to the next one's start.
    covered = F.aggregate(
        F.sequence(F.lit(0), F.size(marks) - 2),
        F.lit(WINDOW).cast("long"),
        lambda a, k: a + F.least(F.lit(WINDOW), F.col(marks)[k + 1] - F.col(marks)[k]),
    )
    return rows.withColumn("n_repeat_words", F.when(F.size(marks) >= 2, covered).otherwise(F.lit(0).cast("long"))).drop(
        ordered, marks
    )


def base_failed() -> Column:
    """Too few words, or too many of them inside windows that repeat."""
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )


def _line_key(line: Column) -> Column:
    return F.xxhash64(_normal_line(line))


def _lines(text: Column) -> Column:
    """(key, size) of each line with words; a null text has none."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(WORD_CHAR))
    return F.transform(lines, lambda x: F.struct(_line_key(x).alias("key"), F.size(F.split(_trimmed(x), GAP, -1)).alias("size")))


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, named, content, lines, statistics ...) of each row, written once: the only reading of the texts.

    named is the host as a key that is never null, content the text's hash.
    """
    rows = docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit("")).alias("named"),
        F.xxhash64("text").alias("content"),
        _lines(F.col("text")).alias("lines"),
        "text",
    )
    return cut(text_statistics(rows, ["doc_id", "named", "content", "lines"]))


def boilerplate(base: DataFrame, max_docs: int = MAX_DOCS, host_part: int = HOST_PART) -> DataFrame:
    """(named, content, keys, held, total): for each text that holds lines above the limits of its host, those lines' hashes,
    their words and all lines' words.

    Documents with equal texts are one document here, so a group of copies doesn't turn its own lines into
    boilerplate.  Lines are normalised and then compared by 64-bit hash.  A null host is a host.
    """
    texts = base.groupBy("named", "content").agg(F.first("lines").alias("lines"))
    lines = cut(texts.select("named", "content", F.explode(F.array_distinct("lines")).alias("line")).select("named", "content", "line.*"))
    limits = texts.groupBy("named").agg((F.count("*") / host_part).alias("least"))
    frequent = lines.groupBy("named", "key").agg(F.count("*").alias("n"), salts("content").alias("parts")).where(F.col("n") > max_docs)
    frequent = frequent.join(limits, "named").where("n > least").select("named", "key", each_salt("parts").alias("part"), F.lit(True).alias("above"))
    marked = lines.withColumn("part", salt("content")).join(frequent, ["named", "key", "part"], "left")
    return (
        marked.groupBy("named", "content")
        .agg(
            F.collect_set(F.when(F.col("above"), F.col("key"))).alias("keys"),
            F.sum(F.when(F.col("above"), F.col("size"))).alias("held"),
            F.sum("size").alias("total"),
        )
        .where("held > 0")
    )


def depleted(max_percent: int = MAX_BOILERPLATE_PERCENT) -> Column:
    return 100 * F.col("held") > max_percent * F.col("total")


def quality_verdicts(docs: DataFrame, host: str = "source") -> DataFrame:
    """A row for each row of docs: doc_id, the statistics, base_failed, kept and n_frequent_lines, the distinct lines that go.

    Nulls: a null text has no words and fails; a null doc_id or host is a value like others.
    Repeated rows are judged alike, each by itself.  Very long texts are read whole.  An empty table gives no rows.
    """
    base = measured(docs, host)
    found = boilerplate(base).select("named", "content", depleted().alias("depleted"), F.size("keys").cast("long").alias("n"))
    return base.join(found, ["named", "content"], "left").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & ~F.coalesce("depleted", F.lit(False))).alias("kept"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_frequent_lines"),
    )


def quality_filter(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows that the rules keep, without the lines above the limits of their host, with docs' own columns.

    n_chars, if there is one, is counted anew where lines went.  What is left of a text is held against the base
    rules again.  A text's verdict depends on its host and itself, so verdicts are joined by both's
    hashes, and only rows whose text may have one are shuffled.
    """
    base = measured(docs, host)
    lines = cut(boilerplate(base))
    failed = base.where(base_failed()).select("named", "content")
    rejected = failed.union(lines.where(depleted()).select("named", "content")).distinct()
    verdicts = cut(rejected.withColumn("keys", F.lit(None).cast("array<bigint>")).union(
        lines.where(~depleted()).join(failed.distinct(), ["named", "content"], "left_anti").select("named", "content", "keys")
    ))
    at, content, hit, new = (fresh(docs, x) for x in ("host", "content", "hit", "new"))
    rows = docs.withColumn(at, F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit(""))).withColumn(content, F.xxhash64("text"))
    marked = may_match(rows, content, verdicts, "content", flag=hit)
    named = verdicts.select(F.col("named").alias("tm_v_named"), F.col("content").alias("tm_v_content"), F.col("keys").alias("tm_v_keys"))
    joined = marked.where(F.col(hit)).join(named, (F.col(at) == F.col("tm_v_named")) & (F.col(content) == F.col("tm_v_content")), "left")
    keys = F.col("tm_v_keys")
    untouched = joined.where("tm_v_named is null").select(*(f"`{c}`" for c in docs.columns))
    stay = F.filter(F.split("text", "\n", -1), lambda x: ~x.rlike(WORD_CHAR) | ~F.array_contains(keys, _line_key(x)))
    changed = cut(joined.where(keys.isNotNull()).withColumn(new, F.array_join(stay, "\n")).drop(at, content, hit, "tm_v_named", "tm_v_content", "tm_v_keys"))
    whole = F.struct(*(F.col(f"`{c}`") for c in changed.columns)).alias("row")
    # Written before it is filtered: a filter would be pushed through the projections and repeat the arrays' expressions.
    again = cut(text_statistics(changed.select(whole, F.col(new).alias("text")), ["row"]).select("row", base_failed().alias("failed"))).where("not failed")

    def value(c: str) -> Column:
        if c == "text":
            return F.col("row").getField(new).alias(c)
        if c == "n_chars":
            return F.char_length(F.col("row").getField(new)).cast(dict(docs.dtypes)[c]).alias(c)
        return F.col("row").getField(c).alias(c)

    own = marked.where(~F.col(hit)).select(*(f"`{c}`" for c in docs.columns))
    return own.unionByName(untouched).unionByName(again.select(*map(value, docs.columns)))


QUALITY_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p
        FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1)
  GROUP BY doc_id
), raw AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d
), lines AS (
  SELECT *, regexp_replace(regexp_replace(lower(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))),
            '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g') AS k,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS size
  FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY doc_id
), dl AS (
  SELECT DISTINCT source, text, k, size FROM lines
), host AS (
  SELECT source, count(DISTINCT text) AS n FROM (SELECT source, coalesce(text, '') || CASE WHEN text IS NULL THEN 'n' ELSE 't' END AS text FROM documents) GROUP BY source
), freq AS (
  SELECT l.source, k FROM dl l JOIN host h ON l.source IS NOT DISTINCT FROM h.source GROUP BY l.source, k HAVING count(*) > 25 AND count(*) > any_value(h.n) / 1000
), depleted AS (
  SELECT dl.source, dl.text, count(freq.k) AS n,
    100 * sum(CASE WHEN freq.k IS NOT NULL THEN size ELSE 0 END) > 60 * sum(size) AS depleted
  FROM dl LEFT JOIN freq ON dl.source IS NOT DISTINCT FROM freq.source AND dl.k = freq.k
  GROUP BY dl.source, dl.text
), stats AS (
  SELECT d.doc_id, d.source, d.text, len(d.w)::BIGINT AS n_words,
         length(array_to_string(d.w, ''))::BIGINT AS word_chars,
         (length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(dup.n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(rep.n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
         AND NOT coalesce(p.depleted, false) AS kept,
       coalesce(p.n, 0)::BIGINT AS n_frequent_lines
FROM stats LEFT JOIN depleted p ON p.source IS NOT DISTINCT FROM stats.source AND p.text = stats.text
"""
