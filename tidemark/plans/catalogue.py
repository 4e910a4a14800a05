"""The named queries over the driver tables, each with its SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import findings, graph, temporal
from tidemark.sources.tables import table, values

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "pii_email_spans"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- detectors ---------------------------------------------------------------------------------------------


def _spans_sql(pattern: str, kind: str, group: int = 0) -> str:
    return rf"""
    WITH m AS (SELECT doc_id, lang, source, regexp_extract_all(text, '{pattern}', {group}) AS v FROM documents),
    e AS (SELECT doc_id, lang, source, unnest(v) AS value, unnest(range(len(v)))::INT AS ordinal FROM m),
    f AS (SELECT *, sha256('{kind}' || chr(31) || source || chr(31) || value) AS fingerprint FROM e)
    SELECT doc_id, lang, source, '{kind}' AS kind, value, ordinal, fingerprint,
           (row_number() OVER (PARTITION BY fingerprint ORDER BY doc_id, ordinal))::INT AS occurrence FROM f
    """


def _spans(spark: SparkSession, sf_dir: str, pattern: str, kind: str, group: int = 0) -> DataFrame:
    return findings.with_fingerprint(findings.detect(table(spark, sf_dir, "documents"), pattern, kind, group))


@query(_spans_sql(T.EMAIL, "email"))
def pii_email_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir, T.EMAIL, "email")


@query(_spans_sql(T.IPV4, "ipv4"))
def ipv4_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir, T.IPV4, "ipv4")


@query(_spans_sql(T.ASSIGNED_TOKEN, "assigned_secret", 2))
def secret_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir, T.ASSIGNED_TOKEN, "assigned_secret", 2)


@query(rf"""
WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '{T.ASSIGNED_TOKEN}', 2)) AS token FROM documents),
c AS (SELECT DISTINCT token, unnest(string_split(token, '')) AS ch, length(token) AS n FROM e),
k AS (SELECT token, ch, n, length(token) - length(replace(token, ch, '')) AS c FROM c),
h AS (SELECT token, round(-sum(c / n * log2(c / n)), 6) AS entropy FROM k GROUP BY token)
SELECT doc_id, token, entropy FROM e JOIN h USING (token) WHERE entropy >= 3.0
""")
def secret_hex_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike(T.ASSIGNED_TOKEN))
    tokens = docs.select("doc_id", F.explode(T.matches(F.col("text"), T.ASSIGNED_TOKEN, 2)).alias("token"))
    return tokens.withColumn("entropy", F.round(T.shannon_entropy(F.col("token")), 6)).where("entropy >= 3.0")


@query(r"""
WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{13,19}')) AS digits FROM documents),
d AS (SELECT doc_id, digits, list_transform(range(length(digits)), lambda i:
  CASE WHEN i % 2 = 1 THEN substr(digits, length(digits) - i::INT, 1)::INT * 2
         - CASE WHEN substr(digits, length(digits) - i::INT, 1)::INT > 4 THEN 9 ELSE 0 END
       ELSE substr(digits, length(digits) - i::INT, 1)::INT END) AS v FROM e)
SELECT doc_id, digits, list_sum(v) % 10 = 0 AS valid FROM d
""")
def pii_cards_luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike(T.DIGIT_RUN))
    runs = docs.select("doc_id", F.explode(T.matches(F.col("text"), T.DIGIT_RUN)).alias("digits"))
    return runs.withColumn("valid", T.luhn_valid(F.col("digits")))


@query(rf"""
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '{T.EMAIL}', '<EMAIL>', 'g'), '{T.IPV4}', '<IP>', 'g'),
  '{T.ASSIGNED_TOKEN}', '\1 = "<TOKEN>"', 'g')) AS redacted_sha FROM documents
""")
def redact_pii_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(findings.redacted(F.col("text")), 256).alias("redacted_sha"))


@query(rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT line, count(*) AS n, count(DISTINCT doc_id) AS docs FROM l WHERE regexp_matches(line, '{T.LICENCE_LINE}') GROUP BY line
""")
def license_line_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike(T.LICENCE_LINE))
    lines = docs.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).where(F.col("line").rlike(T.LICENCE_LINE))
    return lines.groupBy("line").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query("""
SELECT conv_id, turn, role,
  (length(lower(text)) - length(replace(lower(text), 'ignore', ''))) // 6 AS ignore_count,
  contains(lower(text), 'system prompt') OR contains(lower(text), 'ignore previous') AS suspicious
FROM conversations
""")
def prompt_injection_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lower("text")
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        "role",
        F.floor((F.length(text) - F.length(F.replace(text, F.lit("ignore"), F.lit("")))) / 6).alias("ignore_count"),
        (text.contains("system prompt") | text.contains("ignore previous")).alias("suspicious"),
    )


@query(rf"""
SELECT page_id, length(regexp_replace(html, '{T.TAG}', '', 'g')) AS plain_chars,
  len(regexp_extract_all(html, '<script'))::INT AS scripts, len(regexp_extract_all(html, 'href='))::INT AS links FROM pages
""")
def html_strip_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.char_length(F.regexp_replace("html", T.TAG, "")).cast("long").alias("plain_chars"),
        F.regexp_count("html", F.lit("<script")).alias("scripts"),
        F.regexp_count("html", F.lit("href=")).alias("links"),
    )


# --- identity, dedup and deltas ----------------------------------------------------------------------------


@query("""
SELECT sha256(text) AS text_sha, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc
FROM documents GROUP BY text HAVING count(*) > 1
""")
def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha"))
    groups = docs.groupBy("text_sha").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    return groups.where("n > 1")


@query("""
SELECT doc_id, source, sha256(text) AS text_sha FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY source, doc_id) AS r FROM documents) WHERE r = 1
""")
def first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("text_sha"))
    return findings.first_wins(docs, ["text_sha"], ["source", "doc_id"])


@query("""
WITH a AS (SELECT DISTINCT doc_id AS key, true AS was FROM labels), b AS (SELECT DISTINCT doc_id AS key, true AS now FROM documents WHERE lang <> 'de')
SELECT key, CASE WHEN was IS NULL THEN 'new' WHEN now IS NULL THEN 'fixed' ELSE 'unchanged' END AS state
FROM a FULL JOIN b USING (key)
""")
def delta_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents against those in a language that is wanted."""
    wanted = table(spark, sf_dir, "documents").where("lang <> 'de'").select(F.col("doc_id").alias("key"))
    return findings.delta(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key")), wanted, "key")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INT AS n FROM documents),
f AS (SELECT doc_id, n, sha256(trim(regexp_replace(lower(line), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))) AS fingerprint FROM l WHERE trim(line) <> '')
SELECT fingerprint, count(*) AS occurrences, count(DISTINCT doc_id) AS docs FROM f GROUP BY fingerprint HAVING count(*) > 1
""".replace("\\\\", "\\"))
def fingerprint_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).where(F.trim("line") != "")
    prints = lines.select("doc_id", F.sha2(T.normal_space(F.col("line")), 256).alias("fingerprint"))
    return prints.groupBy("fingerprint").agg(F.count("*").alias("occurrences"), F.count_distinct("doc_id").alias("docs")).where("occurrences > 1")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def anti_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_totalprice > 400000")
    return customer.join(orders, customer["c_custkey"] == orders["o_custkey"], "left_anti").select("c_custkey", "c_name")


# --- time --------------------------------------------------------------------------------------------------


@query("""
SELECT user_id, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1
""")
def latest_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts")
    last = rows.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("e"))
    return last.select("user_id", "e.*")


@query("""
SELECT event_id, user_id, last_value(CASE WHEN event_type IN ('error', 'purchase') THEN event_type END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events
""")
def carry_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("event_type").isin("error", "purchase"), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.last(mark, ignorenulls=True).over(order).alias("carried"))


@query("""
SELECT a.event_id AS a, b.event_id AS b, a.user_id, abs(epoch(a.ts)::BIGINT - epoch(b.ts)::BIGINT) AS seconds_apart
FROM (SELECT *, epoch(date_trunc('second', ts))::BIGINT AS t FROM events) a
JOIN (SELECT *, epoch(date_trunc('second', ts))::BIGINT AS t FROM events) b
ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(a.t - b.t) <= 120
""".replace("abs(epoch(a.ts)::BIGINT - epoch(b.ts)::BIGINT)", "abs(a.t - b.t)"))
def band_join_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.band_pairs(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 120)


@query("""
WITH r AS (SELECT user_id, event_id, epoch(date_trunc('second', ts))::BIGINT AS s,
  epoch(date_trunc('second', ts))::BIGINT + (value * 60)::BIGINT AS e FROM (SELECT user_id, event_id, ts, floor(abs(value)) AS value FROM events)),
m AS (SELECT *, CASE WHEN max(e) OVER w IS NULL OR s > max(e) OVER w THEN 1 ELSE 0 END AS o FROM r
  WINDOW w AS (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, count(*) AS n_islands, sum(e - s)::BIGINT AS seconds
FROM (SELECT user_id, k, min(s) AS s, max(e) AS e FROM i GROUP BY user_id, k) GROUP BY user_id
""")
def interval_union_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.unix_timestamp(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select("user_id", start.alias("s"), (start + F.floor(F.abs("value")) * 60).alias("e"))
    return temporal.union_seconds(rows, "user_id", "s", "e")


@query("""
SELECT o_orderpriority, strftime(o_orderdate, '%Y') AS year, count(*) AS n,
  round(avg(date_diff('day', o_orderdate::DATE, l_shipdate::DATE)), 6) AS mean_days
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2
""")
def mttr_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    days = F.date_diff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))
    joined = orders.join(items, orders["o_orderkey"] == items["l_orderkey"])
    return joined.groupBy("o_orderpriority", F.date_format("o_orderdate", "yyyy").alias("year")).agg(
        F.count("*").alias("n"), F.round(F.avg(days), 6).alias("mean_days")
    )


@query("""
SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2
""")
def usage_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "event_type").agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("users")
    )


# --- aggregates --------------------------------------------------------------------------------------------


@query("""
WITH s AS (SELECT unnest(['critical', 'error', 'click', 'purchase', 'signup', 'view']) AS event_type)
SELECT s.event_type, count(e.event_id) AS n FROM s LEFT JOIN events e USING (event_type) GROUP BY 1
""")
def severity_counts_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = values(spark, [(x,) for x in ("critical", "error", "click", "purchase", "signup", "view")], "event_type string")
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("c"))
    return kinds.join(counts, "event_type", "left").select("event_type", F.coalesce("c", F.lit(0)).alias("n"))


@query("SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 10")
def top_k_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type").limit(10)


@query("""
SELECT event_type, count(*) AS requests, count(*) FILTER (WHERE value > 50) AS large, round(sum(value), 4) AS total FROM events GROUP BY 1
""")
def egress_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("requests"), F.count_if(F.col("value") > 50).alias("large"), F.round(F.sum("value"), 4).alias("total")
    )


@query("""
SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS user_votes, count(*) FILTER (WHERE role = 'assistant') AS assistant_votes,
  CASE WHEN count(*) FILTER (WHERE role = 'user') > count(*) FILTER (WHERE role = 'assistant') THEN 'user' ELSE 'assistant' END AS consensus
FROM conversations GROUP BY conv_id
""")
def consensus_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count_if(F.col("role") == "user").alias("user_votes"), F.count_if(F.col("role") == "assistant").alias("assistant_votes")
    )
    return votes.withColumn("consensus", F.when(F.col("user_votes") > F.col("assistant_votes"), "user").otherwise("assistant"))


def _confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    guess = (F.length(F.regexp_replace("text", r"[#*$%&|<>]", "")) < F.length("text") * 0.95).cast("int")
    return docs.select("doc_id", "lang", "source", guess.alias("guess")).join(labels, "doc_id").select(
        "lang", "source", "guess", (F.col("quality") == 0).cast("int").alias("bad")
    )


_CONFUSION_SQL = """
(SELECT lang, source, CASE WHEN length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) < length(text) * 0.95 THEN 1 ELSE 0 END AS guess,
  CASE WHEN quality = 0 THEN 1 ELSE 0 END AS bad FROM documents JOIN labels USING (doc_id))
"""


@query(f"""
SELECT sum(guess * bad)::BIGINT AS tp, sum(guess * (1 - bad))::BIGINT AS fp, sum((1 - guess) * bad)::BIGINT AS fn,
  round(sum(guess * bad) / sum(guess), 6) AS "precision", round(sum(guess * bad) / sum(bad), 6) AS recall FROM {_CONFUSION_SQL}
""")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, b = F.col("guess"), F.col("bad")
    return _confusion(spark, sf_dir).agg(
        F.sum(g * b).alias("tp"),
        F.sum(g * (1 - b)).alias("fp"),
        F.sum((1 - g) * b).alias("fn"),
        F.round(F.try_divide(F.sum(g * b), F.sum(g)), 6).alias("precision"),
        F.round(F.try_divide(F.sum(g * b), F.sum(b)), 6).alias("recall"),
    )


@query(f"""
SELECT lang, source, sum(guess * bad)::BIGINT AS tp, sum(guess)::BIGINT AS reported, count(*) AS n
FROM {_CONFUSION_SQL} GROUP BY GROUPING SETS ((lang), (source), ())
""")
def pr_breakdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _confusion(spark, sf_dir)
    return rows.groupingSets([[rows.lang], [rows.source], []], "lang", "source").agg(
        F.sum(F.col("guess") * F.col("bad")).alias("tp"), F.sum("guess").alias("reported"), F.count("*").alias("n")
    )


@query("SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (lang, source)")
def rollup_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


# --- joins and policies ------------------------------------------------------------------------------------


@query("""
SELECT c_custkey, c_name, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)::INT AS place FROM customer JOIN orders ON c_custkey = o_custkey
WHERE o_totalprice > 200000 AND c_mktsegment = 'BUILDING'
""")
def fk_join_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    joined = customer.join(orders, customer["c_custkey"] == orders["o_custkey"])
    newest = Window.partitionBy("c_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return joined.select("c_custkey", "c_name", "o_orderkey", "o_totalprice", F.row_number().over(newest).alias("place"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def paged_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(50)


@query("""
SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'O') AS open,
  count(*) FILTER (WHERE o_orderstatus = 'F') AS fixed, count(*) FILTER (WHERE o_totalprice > 100000) AS large FROM orders GROUP BY 1
""")
def saved_view_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("o_orderstatus") == "O").alias("open"),
        F.count_if(F.col("o_orderstatus") == "F").alias("fixed"),
        F.count_if(F.col("o_totalprice") > 100000).alias("large"),
    )


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events WHERE json_extract_string(props, '$.k')::INT >= 50")
def props_json_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).where("k >= 50")


_GLOBS = [(0, "%BRASS%", "legacy metal"), (1, "PROMO%", "promotion"), (2, "%STEEL", "steel")]


@query("""
WITH r AS (SELECT p_partkey, p_type, CASE WHEN p_type LIKE '%BRASS%' THEN 0 WHEN p_type LIKE 'PROMO%' THEN 1 WHEN p_type LIKE '%STEEL' THEN 2 END AS rule FROM part)
SELECT p_partkey, rule, rule IS NOT NULL AS suppressed FROM r
""")
def glob_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = None
    for ordinal, pattern, _ in _GLOBS:
        test = F.col("p_type").like(pattern)
        first = F.when(test, ordinal) if first is None else first.when(test, ordinal)
    rows = table(spark, sf_dir, "part").select("p_partkey", first.alias("rule"))
    return rows.withColumn("suppressed", F.col("rule").isNotNull())


_LEVELS = [("Brand#1", 1), ("Brand#2", 2), ("Brand#3", 3), ("Brand#13", 4)]


@query("""
WITH l(prefix, level) AS (VALUES ('Brand#1', 1), ('Brand#2', 2), ('Brand#3', 3), ('Brand#13', 4)),
m AS (SELECT p_partkey, prefix, level, row_number() OVER (PARTITION BY p_partkey ORDER BY length(prefix) DESC) AS r
  FROM part JOIN l ON starts_with(p_brand, prefix))
SELECT p_partkey, prefix, level FROM m WHERE r = 1
""")
def longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = F.broadcast(values(spark, _LEVELS, "prefix string, level int"))  # four rows
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    met = part.join(levels, F.col("p_brand").startswith(F.col("prefix")))
    best = met.groupBy("p_partkey").agg(F.max_by(F.struct("prefix", "level"), F.length("prefix")).alias("b"))
    return best.select("p_partkey", "b.*")


@query("""
WITH l(prefix, level) AS (VALUES ('Brand#1', 1), ('Brand#2', 2), ('Brand#3', 3), ('Brand#13', 4))
SELECT p_partkey, greatest(coalesce(max(level), 0), CASE WHEN p_size > 40 THEN 3 ELSE 0 END) AS level
FROM part LEFT JOIN l ON starts_with(p_brand, prefix) GROUP BY p_partkey, p_size
""")
def policy_strictest(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = F.broadcast(values(spark, _LEVELS, "prefix string, level int"))  # four rows
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    met = part.join(levels, F.col("p_brand").startswith(F.col("prefix")), "left").groupBy("p_partkey", "p_size").agg(F.max("level").alias("m"))
    return met.select(
        "p_partkey", F.greatest(F.coalesce("m", F.lit(0)), F.when(F.col("p_size") > 40, 3).otherwise(0)).alias("level")
    )


@query("""
WITH b AS (SELECT DISTINCT unnest(list_transform(range(1, greatest(len(w) - 8, 0) + 1), lambda i: array_to_string(w[i:i + 8], ' '))) AS g
  FROM (SELECT regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark)),
d AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 8, 0) + 1), lambda i: array_to_string(w[i:i + 8], ' '))) AS g
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS w FROM documents))
SELECT doc_id, count(*) AS shared FROM d WHERE g IN (SELECT g FROM b) GROUP BY doc_id
""")
def benchmark_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    def shingles(rows: DataFrame, *keep: str) -> DataFrame:
        words = rows.select(*keep, F.split(F.trim(F.regexp_replace(F.lower("text"), r"[\x20\x09-\x0D]+", " ")), " ").alias("w"))
        # A projection of its own keeps the array from being split anew for each shingle.
        n = F.size("w")
        grams = F.transform(F.sequence(F.lit(1), n - 8), lambda i: F.array_join(F.slice("w", i, 9), " "))
        return words.where(n >= 9).select(*keep, F.explode(grams).alias("g"))

    known = shingles(table(spark, sf_dir, "benchmark")).distinct()
    mine = shingles(table(spark, sf_dir, "documents"), "doc_id")
    return mine.join(known, "g", "left_semi").groupBy("doc_id").agg(F.count("*").alias("shared"))


@query("""
WITH RECURSIVE n AS (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem),
e AS (SELECT DISTINCT a, b FROM n WHERE b IS NOT NULL),
r AS (SELECT min(p_partkey) AS node FROM part UNION SELECT b FROM r JOIN e ON a = node) SELECT node FROM r
""")
def callgraph_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first part reaches, where a part calls the one on the next line of an order."""
    lines = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(lines).alias("b"))
    roots = table(spark, sf_dir, "part").agg(F.min("p_partkey").alias("node"))
    return graph.reachable(edges.where("b IS NOT NULL").distinct(), roots)


@query("""
SELECT l_orderkey, l_linenumber, running FROM (SELECT l_orderkey, l_linenumber,
  sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) AS running FROM lineitem) WHERE running <= 100
""")
def running_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(Window.unboundedPreceding, 0)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.sum("l_quantity").over(order).alias("running"))
    return rows.where("running <= 100")
