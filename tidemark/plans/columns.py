"""Checks and normal forms over columns made from the driver tables; their SQL computes each answer by its own means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import codes, formats, scalars
from tidemark.operators import advisories, risk, triage
from tidemark.plans.catalogue import query
from tidemark.plans.posture import _VERSIONS, part_versions
from tidemark.sources.tables import table


def _pick(options: str | list[str], by: str) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (F.expr(by) % len(options) + 1).cast("int"))


# --- scores and orders -------------------------------------------------------------------------------------


@query("""
WITH v AS (SELECT ['N', 'A', 'L', 'P'][l_linenumber % 4 + 1] AS av, ['L', 'H'][l_suppkey % 2 + 1] AS ac, ['N', 'L', 'H'][l_partkey % 3 + 1] AS pr, ['N', 'R'][l_orderkey % 2 + 1] AS ui, ['U', 'C'][(l_orderkey // 2) % 2 + 1] AS s,
  ['H', 'L', 'N'][(l_partkey // 3) % 3 + 1] AS c, ['H', 'L', 'N'][(l_suppkey // 2) % 3 + 1] AS i, ['H', 'L', 'N'][(l_orderkey // 4) % 3 + 1] AS a FROM lineitem),
w AS (SELECT *, MAP {'H': 0.56, 'L': 0.22, 'N': 0.0} AS m FROM v),
x AS (SELECT av || ac || pr || ui || s || c || i || a AS vector, s, 1 - (1 - m[c]) * (1 - m[i]) * (1 - m[a]) AS iss,
  8.22 * MAP {'N': 0.85, 'A': 0.62, 'L': 0.55, 'P': 0.2}[av] * MAP {'L': 0.77, 'H': 0.44}[ac] * MAP {'NU': 0.85, 'NC': 0.85, 'LU': 0.62, 'LC': 0.68, 'HU': 0.27, 'HC': 0.5}[pr || s] * MAP {'N': 0.85, 'R': 0.62}[ui] AS ease FROM w),
y AS (SELECT vector, s, ease, CASE s WHEN 'U' THEN 6.42 * iss ELSE 7.52 * (iss - 0.029) - 3.25 * pow(iss - 0.02, 15) END::DOUBLE AS impact FROM x),
z AS (SELECT vector, impact, round(least(CASE s WHEN 'C' THEN 1.08 ELSE 1 END * (impact + ease), 10) * 100000)::BIGINT AS scaled FROM y)
SELECT vector, CASE WHEN impact <= 0 THEN 0 WHEN scaled % 10000 = 0 THEN scaled / 100000 ELSE (scaled // 10000 + 1) / 10 END::DOUBLE AS base_score, count(*) AS n FROM z GROUP BY ALL
""")
def cvss31_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base scores of a vector a line."""
    rows = table(spark, sf_dir, "lineitem").select(
        _pick("NALP", "l_linenumber").alias("av"), _pick("LH", "l_suppkey").alias("ac"), _pick("NLH", "l_partkey").alias("pr"), _pick("NR", "l_orderkey").alias("ui"), _pick("UC", "l_orderkey div 2").alias("s"),
        _pick("HLN", "l_partkey div 3").alias("c"), _pick("HLN", "l_suppkey div 2").alias("i"), _pick("HLN", "l_orderkey div 4").alias("a"),
    )
    vector = F.concat("av", "ac", "pr", "ui", "s", "c", "i", "a").alias("vector")
    return risk.cvss31_base(rows).groupBy(vector, "base_score").agg(F.count("*").alias("n"))


@query(f"""
WITH {_VERSIONS} SELECT id, ecosystem, version, dense_rank() OVER (PARTITION BY ecosystem, lib ORDER BY key)::INT AS place FROM v
""")
def version_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each part's version among those of its library, in four ecosystems' orders."""
    rows = advisories.keyed(part_versions(spark, sf_dir), key="version")
    return rows.select("id", "ecosystem", "version", F.dense_rank().over(Window.partitionBy("ecosystem", "lib").orderBy("key")).alias("place"))


# --- check digits ------------------------------------------------------------------------------------------


@query("""
WITH perm AS (SELECT [1, 5, 7, 6, 2, 8, 3, 0, 9, 4] AS p),
pt AS (SELECT list(list_reduce(range(i // 10), lambda x, k: p[x + 1]::BIGINT, i % 10) ORDER BY i) AS p FROM perm, range(80) t(i)),
dt AS (SELECT list(CASE WHEN i < 50 THEN CASE WHEN i % 10 < 5 THEN (i // 10 + i % 10) % 5 ELSE 5 + (i // 10 + i % 10) % 5 END WHEN i % 10 < 5 THEN 5 + (i // 10 - i % 10 + 10) % 5 ELSE (i // 10 - i % 10 + 10) % 5 END ORDER BY i) AS d FROM range(100) t(i)),
n AS (SELECT o_orderkey, o_custkey || '0' || o_orderkey || (o_orderkey % 10) AS number FROM orders)
SELECT o_orderkey, number, list_reduce(range(length(number)), lambda c, i: d[c * 10 + p[(i % 8) * 10 + substr(number, -1 - i, 1)::BIGINT + 1] + 1]::BIGINT, 0::BIGINT) = 0 AS valid FROM n, pt, dt
""")
def verhoeff_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers made from orders, a tenth of which end in the scheme's check digit."""
    number = F.concat(F.col("o_custkey").cast("string"), F.lit("0"), F.col("o_orderkey").cast("string"), (F.col("o_orderkey") % 10).cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", number.alias("number"))
    return rows.withColumn("valid", scalars.verhoeff_valid(F.col("number")))


_VALUES = """
m AS (SELECT c_custkey AS k, 'iban' AS kind, CASE WHEN c_custkey % 2 = 0 THEN 'GB' ELSE 'gb' END || lpad((c_custkey % 97)::VARCHAR, 2, '0') || ' WEST' || lpad((c_custkey * 31)::VARCHAR, 14, '0') AS value FROM customer
UNION ALL SELECT c_custkey, 'gstin', '27AAPFU' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') || 'F1Z' || substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', (c_custkey % 36)::INT + 1, 1) FROM customer
UNION ALL SELECT c_custkey, 'birth', (c_custkey % 40) || ['/', '-', '.'][c_custkey % 3 + 1] || (c_custkey % 15) || ['/', '-', '.'][c_custkey % 3 + 1] || (1890 + c_custkey % 230) FROM customer
UNION ALL SELECT c_custkey, 'card', ['4', '51', '37', '12'][c_custkey % 4 + 1] || lpad((c_custkey * 7919)::VARCHAR, (13 + c_custkey % 3)::INT, '7') FROM customer)
"""
_NETWORKS = "(" + " OR ".join(f"(regexp_matches(value, '^(?:{p})') AND length(value) IN ({', '.join(map(str, sizes))}))" for p, sizes in codes.CARD_NETWORKS) + ")"
_BASE36 = "(strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr(value, i + 1, 1)) - 1)"


@query(f"""
WITH {_VALUES}, c AS (SELECT *, upper(replace(value, ' ', '')) AS u, list_transform(regexp_extract_all(value, '[0-9]+'), lambda x: try_cast(x AS INT)) AS p FROM m)
SELECT k, kind, value, CASE kind
  WHEN 'iban' THEN ('32142829' || substr(u, 9) || '1611' || substr(u, 3, 2))::HUGEINT % 97 = 1
  WHEN 'gstin' THEN (36 - list_sum(list_transform(range(14), lambda i: {_BASE36} * (1 + i % 2) // 36 + {_BASE36} * (1 + i % 2) % 36)) % 36) % 36 = strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr(value, 15, 1)) - 1
  WHEN 'birth' THEN p[3] BETWEEN 1900 AND 2100 AND CASE WHEN p[1] > 31 THEN false ELSE coalesce(try_cast(p[3] || '-' || p[2] || '-' || p[1] AS DATE) IS NOT NULL, false) OR coalesce(try_cast(p[3] || '-' || p[1] || '-' || p[2] AS DATE) IS NOT NULL, false) END
  ELSE {_NETWORKS} AND list_sum(list_transform(range(length(value)), lambda i: CASE WHEN i % 2 = 0 THEN substr(value, -1 - i, 1)::INT ELSE (substr(value, -1 - i, 1)::INT * 2) // 10 + (substr(value, -1 - i, 1)::INT * 2) % 10 END)) % 10 = 0 END AS valid FROM c
""")
def iban_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check digits and characters of account, tax and card numbers, and dates of birth, made from customers' keys."""
    k = F.col("c_custkey")
    text = lambda c: c.cast("string")
    sign = _pick(["/", "-", "."], "c_custkey")
    made = {
        "iban": F.concat(_pick(["GB", "gb"], "c_custkey"), F.lpad(text(k % 97), 2, "0"), F.lit(" WEST"), F.lpad(text(k * 31), 14, "0")),
        "gstin": F.concat(F.lit("27AAPFU"), F.lpad(text(k % 10000), 4, "0"), F.lit("F1Z"), _pick("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "c_custkey")),
        "birth": F.concat(text(k % 40), sign, text(k % 15), sign, text(k % 230 + 1890)),
        "card": F.concat(_pick(["4", "51", "37", "12"], "c_custkey"), F.expr("lpad(cast(c_custkey * 7919 AS string), cast(13 + c_custkey % 3 AS int), '7')")),
    }
    each = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), v.alias("value")) for kind, v in made.items()))).alias("v")
    rows = table(spark, sf_dir, "customer").select(k.alias("k"), each).select("k", "v.*")
    return rows.withColumn("valid", triage.number_valid(F.col("kind"), F.col("value")))


# --- normal forms ------------------------------------------------------------------------------------------


@query(r"""
WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') AS p FROM pages),
q AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN replace(p, '/', '\') WHEN 1 THEN 'a/./' || p WHEN 2 THEN 'x/../' || p WHEN 3 THEN '/' || p WHEN 4 THEN rtrim(p, '/') || '/' WHEN 5 THEN 'C:' || p WHEN 6 THEN replace(p, '/', '//') ELSE p END AS path FROM p),
s AS (SELECT *, replace(path, '\', '/') AS t, list_filter(string_split(replace(path, '\', '/'), '/'), lambda x: x NOT IN ('', '.')) AS parts FROM q)
SELECT page_id, path, CASE WHEN t[1] = '/' OR t[-1] = '/' OR list_contains(parts, '..') OR len(parts) = 0 OR regexp_matches(t, '^[A-Za-z]:') THEN NULL ELSE array_to_string(parts, '/') END AS normal FROM s
""")
def path_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' paths with odd separators, dots, drives and roots."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://|[?#].*$", "").alias("p"))
    kinds = (
        r"replace(p, '/', '\\')", "concat('a/./', p)", "concat('x/../', p)", "concat('/', p)", "concat(rtrim('/', p), '/')", "concat('C:', p)", "replace(p, '/', '//')", "p",
    )
    path = F.expr("CASE page_id % 8 " + " ".join(f"WHEN {i} THEN {k}" for i, k in enumerate(kinds)) + " END")
    return rows.select("page_id", path.alias("path")).withColumn("normal", codes.repository_path(F.col("path")))


_NAMES_SQL = """
w AS (SELECT p_partkey, p_size, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b, p_type AS t FROM part),
c AS (SELECT *, upper(a[1]) || a[2:] AS ca, upper(b[1]) || b[2:] AS cb FROM w)
"""


@query(f"""
WITH {_NAMES_SQL} SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN a || cb || p_size WHEN 1 THEN '__' || a || '_' || b || '-' || p_size || 'x' WHEN 2 THEN t || ca || cb WHEN 3 THEN ca || t || '_' || p_size || cb ELSE a || '.' || t END AS name,
  CASE p_partkey % 5 WHEN 0 THEN a || ' ' || cb || ' ' || p_size WHEN 1 THEN a || ' ' || b || ' ' || p_size || ' x' WHEN 2 THEN t || ' ' || ca || ' ' || cb WHEN 3 THEN ca || ' ' || t || ' ' || p_size || ' ' || cb ELSE a || ' ' || t END AS words FROM c
""")
def identifier_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of identifiers made from parts' names, types and sizes."""
    a, b = (F.element_at(F.split("p_name", " "), i) for i in (1, 2))
    size, kind = F.col("p_size").cast("string"), F.col("p_type")
    made = (
        F.concat(a, F.initcap(b), size), F.concat(F.lit("__"), a, F.lit("_"), b, F.lit("-"), size, F.lit("x")), F.concat(kind, F.initcap(a), F.initcap(b)),
        F.concat(F.initcap(a), kind, F.lit("_"), size, F.initcap(b)), F.concat(a, F.lit("."), kind),
    )
    name = F.element_at(F.array(*made), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name")).withColumn("words", F.array_join(codes.sub_words(F.col("name")), " "))


_ECOSYSTEMS = ["PyPI", "npm", "Maven", "Go", "NuGet", "RubyGems"]


@query(f"""
WITH n AS (SELECT p_partkey, {_ECOSYSTEMS}[p_partkey % 6 + 1] AS ecosystem, p_type || replace(p_name, ' ', ['_', '.', '--', '/', '-_.'][p_size % 5 + 1]) AS name FROM part)
SELECT p_partkey, ecosystem, name, CASE WHEN ecosystem = 'PyPI' THEN lower(regexp_replace(name, '[-_.]+', '-', 'g')) WHEN ecosystem IN ('Maven', 'Go') THEN name ELSE lower(name) END AS lookup FROM n
""")
def package_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of packages made from parts, as each ecosystem looks them up."""
    gap = _pick(["_", ".", "--", "/", "-_."], "p_size")
    rows = table(spark, sf_dir, "part").select("p_partkey", _pick(_ECOSYSTEMS, "p_partkey").alias("ecosystem"), F.concat("p_type", F.replace("p_name", F.lit(" "), gap)).alias("name"))
    return rows.withColumn("lookup", codes.package_name(F.col("ecosystem"), F.col("name")))


@query("""
WITH p AS (SELECT p_partkey AS k, md5(p_name || p_partkey) AS h, p_name, p_size FROM part),
v AS (SELECT k, p_size, CASE k % 9 WHEN 0 THEN h WHEN 1 THEN h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] WHEN 2 THEN base64(encode(p_name || ' and ' || p_name)) WHEN 3 THEN repeat('x', (4 + p_size)::INT)
  WHEN 4 THEN '${' || upper(p_name[1:3]) || '}' WHEN 5 THEN 'your_' || replace(p_name, ' ', '_') || '_here' WHEN 6 THEN 'K9' || h[1:10] WHEN 7 THEN 'sha256-' || h ELSE 'Q7' || h[1:20] END AS value,
  ['yarn.lock', 'src/a.py', 'tests/a.py'][p_size % 3 + 1] AS path, CASE WHEN p_size % 4 = 0 THEN 'sha256' END AS field, CASE WHEN p_size % 5 = 0 THEN 'an Example' ELSE '' END AS line, p_size % 25 AS times FROM p)
SELECT k, value, CASE WHEN k % 9 IN (0, 7) AND (path = 'yarn.lock' OR field = 'sha256') THEN 'hash_in_manifest' WHEN k % 9 = 1 THEN 'uuid' WHEN k % 9 = 2 THEN 'base64_text' WHEN k % 9 IN (3, 4, 5) THEN 'placeholder_value'
  WHEN path LIKE 'tests/%' AND line <> '' THEN 'example_marker' WHEN times > 20 THEN 'repeated_value' END AS rule FROM v
""")
def secret_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that tell values from secrets, over values made from parts."""
    h = "md5(concat(p_name, p_partkey))"
    kinds = (
        h, f"concat_ws('-', substr({h}, 1, 8), substr({h}, 9, 4), substr({h}, 13, 4), substr({h}, 17, 4), substr({h}, 21))", "base64(encode(concat(p_name, ' and ', p_name), 'utf-8'))", "repeat('x', 4 + p_size)",
        r"concat('$', '{', upper(substr(p_name, 1, 3)), '}')", "concat('your_', replace(p_name, ' ', '_'), '_here')", f"concat('K9', substr({h}, 1, 10))", f"concat('sha256-', {h})", f"concat('Q7', substr({h}, 1, 20))",
    )
    value = F.expr("CASE p_partkey % 9 " + " ".join(f"WHEN {i} THEN {k}" for i, k in enumerate(kinds)) + " END")
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("k"), value.alias("value"), _pick(["yarn.lock", "src/a.py", "tests/a.py"], "p_size").alias("path"), F.when(F.col("p_size") % 5 == 0, "an Example").otherwise("").alias("line"),
        F.when(F.col("p_size") % 4 == 0, "sha256").alias("field"), (F.col("p_size") % 25).alias("times"),
    )
    return rows.select("k", "value", formats.secret_filter(*(F.col(c) for c in ("value", "path", "line", "field", "times"))).alias("rule"))
