"""Secrets without a shape of their own, and all detectors together, over documents with assignments at their ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import detection, overlaps, secrets, terms
from tidemark.plans.catalogue import query
from tidemark.plans.relations import part_terms
from tidemark.sources.tables import table, values

_TEXTS = """
d AS (SELECT doc_id, source || CASE WHEN doc_id % 2 = 0 THEN '.env' ELSE '.py' END AS path, text || chr(10) || 'user_password' || ['=', ' := ', '=>'][doc_id % 3 + 1] || '"'
  || substr(md5(doc_id::VARCHAR), 1, (doc_id % 20)::INT) || '"' || chr(10) || 'export apiKey: ' || upper(md5('k' || doc_id)) || chr(10) || 'tokenLength = "' || doc_id || '000000"' || chr(10)
  || 'x' || chr(39) || substr(sha256(doc_id::VARCHAR), 1, (doc_id % 9 + 24)::INT) || 'Zz_' || chr(39) || chr(10) || 'auth: changeme' || chr(10) || 'secret: $HOME' AS text FROM documents)
"""


def secret_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, text): the documents, each with lines of assignments made from its id."""
    key = F.col("doc_id").cast("string")
    sign = F.element_at(F.array(F.lit("="), F.lit(" := "), F.lit("=>")), (F.col("doc_id") % 3 + 1).cast("int"))
    end = F.concat(
        F.lit("\nuser_password"), sign, F.lit('"'), F.expr("substr(md5(cast(doc_id AS string)), 1, cast(doc_id % 20 AS int))"), F.lit('"\nexport apiKey: '), F.upper(F.md5(F.concat(F.lit("k"), key))),
        F.lit('\ntokenLength = "'), key, F.lit("000000\"\nx'"), F.expr("substr(sha2(cast(doc_id AS string), 256), 1, cast(doc_id % 9 + 24 AS int))"), F.lit("Zz_'\nauth: changeme\nsecret: $HOME"),
    )
    path = F.concat("source", F.when(F.col("doc_id") % 2 == 0, ".env").otherwise(".py"))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.concat("text", end).alias("text"))


_NAME = r"""([A-Za-z_][A-Za-z0-9_.\-]{0,63})["'']?[ \t]*(?::=|=>|=|:)[ \t]*"""
_QUOTED = [rf"""(?:^|[^A-Za-z0-9_.\-])["'']?{_NAME}{q}([^{q}\\\r\n]{{4,512}}){q}""" for q in ('"', "''")]
_BARE = rf"""(?m)^[ \t-]*(?:export[ \t]+)?["'']?{_NAME}([^\s"''#,;]{{4,512}})[ \t]*\r?$"""
_CREDENTIAL = rf"""
w AS (SELECT *, regexp_extract_all(lower(regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')), '[a-z]+|[0-9]+') AS words FROM a),
c AS (SELECT * FROM w WHERE len(words) > 0 AND NOT list_contains(string_split('{secrets.OTHER_HEADS}', ' '), words[-1])
  AND (len(list_intersect(words, {list(secrets.CREDENTIAL_WORDS)})) > 0 OR len(list_filter(range(1, len(words)), lambda i: list_contains({list(secrets.CREDENTIAL_PAIRS)}, words[i] || ' ' || words[i + 1]))) > 0))
"""


def _found(pattern: str, where: str = "true") -> str:
    return f"SELECT doc_id, text, unnest(list_zip(regexp_extract_all(text, '{pattern}', 1), regexp_extract_all(text, '{pattern}', 2))) AS z FROM d WHERE {where}"


@query(rf"""
WITH {_TEXTS}, q AS ({_found(_QUOTED[0])} UNION ALL {_found(_QUOTED[1])}), b AS ({_found(_BARE, "path LIKE '%.env'")}),
a AS (SELECT doc_id, text, z[1] AS name, z[2] AS value FROM q UNION ALL SELECT doc_id, text, z[1], z[2] FROM b WHERE NOT regexp_matches(z[2], '^[$%<!&*|>@{{\[(]')), {_CREDENTIAL}
SELECT doc_id AS ident, name, value, CASE WHEN length(value) >= 12 AND value <> 'changeme' THEN 'medium' ELSE 'low' END AS confidence,
  octet_length(encode(substr(any_value(text), 1, strpos(any_value(text), value) - 1))) AS first_byte, count(*) AS n
FROM c WHERE lower(value) NOT IN ('true', 'false', 'null', 'none') GROUP BY doc_id, name, value
""")
def assigned_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that documents assign to credential names, in quotes or in files of settings."""
    known = values(spark, [("ChangeMe",)], "value string")
    found = secrets.assigned(secret_texts(spark, sf_dir), "doc_id", "text", "path", known)
    name = F.regexp_replace("name", "[\"']", "").alias("name")
    return found.groupBy("ident", name, "value", "confidence").agg(F.min("first_byte").alias("first_byte"), F.count("*").alias("n"))


_TOKEN = r"([A-Za-z0-9+/=_\-]{16,512})"
_LINE = rf"""(?m)^[ \t]*(?:export[ \t]+)?[A-Za-z0-9_.\-"'']{{1,64}}[ \t]*[:=][ \t]*{_TOKEN}[ \t]*\r?$"""
_ALPHABET = " ".join(f"WHEN regexp_full_match(value, '{p}') AND length(value) >= {n} THEN '{a}'" for a, p, n, _ in secrets.ALPHABETS)
_BITS = " ".join(f"WHEN '{a}' THEN {b}" for a, _, _, b in secrets.ALPHABETS)


@query(rf"""
WITH {_TEXTS}, c AS (SELECT doc_id, unnest(list_concat(regexp_extract_all(text, '"{_TOKEN}"', 1), regexp_extract_all(text, '''{_TOKEN}''', 1), regexp_extract_all(text, '`{_TOKEN}`', 1), regexp_extract_all(text, '{_LINE}', 1))) AS value FROM d),
k AS (SELECT doc_id, value, CASE {_ALPHABET} END AS alphabet, count(*) AS n FROM c GROUP BY doc_id, value),
s AS (SELECT DISTINCT value, unnest(string_split(value, '')) AS ch FROM k WHERE alphabet IS NOT NULL),
h AS (SELECT value, -sum(p * log2(p)) AS bits FROM (SELECT value, (length(value) - length(replace(value, ch, ''))) / length(value) AS p FROM s) GROUP BY value),
t AS (SELECT value, sum(n) AS times FROM k GROUP BY value)
SELECT doc_id AS ident, value, alphabet, round(bits, 6) AS bits, times > 20 AS downgraded, n FROM k JOIN h USING (value) JOIN t USING (value) WHERE bits >= CASE alphabet {_BITS} END
""")
def entropic_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens whose entropy is too high for the narrowest alphabet that they fit."""
    found = secrets.entropic(secret_texts(spark, sf_dir), "doc_id", "text", "path")
    return found.groupBy("ident", "value", "alphabet", F.round("bits", 6).alias("bits"), "downgraded").agg(F.count("*").alias("n"))


@query()
def all_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats, assignments, entropy and parts' names in all documents, without overlaps; tests have the cases."""
    docs = secret_texts(spark, sf_dir)
    hits = terms.term_hits(docs, "doc_id", "text", part_terms(spark, sf_dir))
    return overlaps.without_overlaps(detection.detected([
        detection.known_formats(docs, "doc_id", "text", "path"),
        secrets.assigned(docs, "doc_id", "text", "path"),
        secrets.entropic(docs, "doc_id", "text", "path"),
        hits.select("ident", F.lit("term").alias("kind"), F.lit("domain").alias("subtype"), F.lit("high").alias("confidence"), "value", "start_byte", "end_byte", F.lit(False).alias("downgraded")),
    ]))
