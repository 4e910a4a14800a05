"""Detection, redaction, ratings, reports and bills of material over the driver tables.

The tables hold few secrets, so texts are made from customers' keys; their SQL knows where each value stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import codes
from tidemark.operators import detection, overlaps, rating
from tidemark.operators.graph import stored
from tidemark.plans.catalogue import query
from tidemark.plans.security import _F, scan_findings
from tidemark.sources import reports
from tidemark.sources.tables import scratch, table

#: Parts into which the made texts are dealt.
TEXT_PARTS = 96
_TEXTS = """
t AS (SELECT c_custkey AS k, 'AKIA' || upper(substr(md5(c_custkey::VARCHAR), 1, 16)) AS aws, 'ghp_' || substr(md5(c_custkey::VARCHAR) || md5(c_custkey::VARCHAR), 1, 36) AS gh,
  'user' || c_custkey || '@mail' || (c_custkey % 97) || '.org' AS mail, '10.' || (c_custkey % 256) || '.3.' || (c_custkey % 7) AS ip FROM customer),
x AS (SELECT *, 'é id ' || k || ' key=' || aws || ' <' || mail || '> from ' || ip || chr(10) || gh AS text FROM t)
"""


def made_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, text): a line a customer with a key, a mail address, a host and a token."""
    key = F.col("c_custkey").cast("string")
    digest = F.md5(key)
    place = F.concat(F.lit("10."), (F.col("c_custkey") % 256).cast("string"), F.lit(".3."), (F.col("c_custkey") % 7).cast("string"))
    mail = F.concat(F.lit("user"), key, F.lit("@mail"), (F.col("c_custkey") % 97).cast("string"), F.lit(".org"))
    text = F.concat(
        F.lit("é id "), key, F.lit(" key=AKIA"), F.upper(F.substring(digest, 1, 16)), F.lit(" <"), mail, F.lit("> from "), place,
        F.lit("\nghp_"), F.substring(F.concat(digest, digest), 1, 36),
    )
    # Keys are small, so few files hold them; the texts made from them are dealt to all tasks.
    keys = table(spark, sf_dir, "customer").select("c_custkey").repartition(TEXT_PARTS)
    return keys.select(F.col("c_custkey").alias("k"), text.alias("text"))


def _found(docs: DataFrame, ident: str) -> DataFrame:
    return detection.known_formats(docs, ident, "text")


@query(f"""
WITH {_TEXTS}, e AS (SELECT k, text, unnest([{{'kind': 'secret', 'subtype': 'aws_access_key', 'confidence': 'high', 'value': aws}}, {{'kind': 'secret', 'subtype': 'github_token', 'confidence': 'high', 'value': gh}},
  {{'kind': 'pii', 'subtype': 'email', 'confidence': 'high', 'value': mail}}, {{'kind': 'pii', 'subtype': 'ipv4', 'confidence': 'medium', 'value': ip}}]) AS s FROM x)
SELECT k AS ident, s.kind AS kind, s.subtype AS subtype, s.confidence AS confidence, s.value AS value, strpos(text, s.value) AS start_byte, strpos(text, s.value) + length(s.value) AS end_byte FROM e
""")
def format_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All formats over the made texts."""
    return _found(made_texts(spark, sf_dir), "k").drop("name", "downgraded")


@query(f"""
WITH {_TEXTS}, h AS (SELECT ip, row_number() OVER (ORDER BY min(k)) AS m FROM x GROUP BY ip), n AS (SELECT k, ip, row_number() OVER (ORDER BY k) AS n FROM x)
SELECT k, 'é id ' || k || ' key=<SECRET:aws_access_key:' || n || '> <<PII:email:' || n || '>> from <PII:ipv4:' || m || '>' || chr(10) || '<SECRET:github_token:' || n || '>' AS text FROM n JOIN h USING (ip)
""")
def numbered_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values replaced by tokens that number them by kind, as first seen in all texts."""
    docs = made_texts(spark, sf_dir)
    return detection.redacted_texts(docs, "k", "text", stored(detection.with_tokens(stored(overlaps.without_overlaps(_found(docs, "k"))))))


@query()
def document_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and credentials of all documents, without overlaps; tests have the cases."""
    return overlaps.without_overlaps(_found(table(spark, sf_dir, "documents"), "doc_id"))


_SPANS = "l_orderkey AS ident, l_linenumber % 3 AS k, l_suppkey % 3 AS c, l_partkey % 40 AS s, l_partkey % 40 + 1 + l_quantity::INT % 12 AS e, 's' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS subtype"


@query(f"""
WITH r AS (SELECT {_SPANS} FROM lineitem),
u AS (SELECT * FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.ident = a.ident AND b.k = a.k AND b.subtype <> a.subtype AND b.s <= a.s AND b.e >= a.e
  AND (b.s < a.s OR b.e > a.e OR b.c > a.c OR (b.c = a.c AND b.subtype < a.subtype)))),
b AS (SELECT *, unnest(range(s, e)) AS pos FROM u),
w AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY ident, pos ORDER BY k, c DESC, s, e DESC, subtype) = 1)
SELECT ident, ['secret', 'pii', 'term'][k + 1] AS kind, subtype, count(*) AS bytes, min(pos)::BIGINT AS first_byte FROM w GROUP BY ident, k, subtype
""")
def overlap_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans made of lines, an order as one text: the bytes that each keeps."""
    start = F.col("l_partkey") % 40
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("ident"), pick(overlaps.KINDS, F.col("l_linenumber") % 3).alias("kind"),
        F.concat(F.lit("s"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey")).alias("subtype"), pick(codes.CONFIDENCES, F.col("l_suppkey") % 3).alias("confidence"),
        F.lit("").alias("value"), start.cast("long").alias("start_byte"), (start + 1 + F.round("l_quantity").cast("int") % 12).cast("long").alias("end_byte"),
    )
    return overlaps.without_overlaps(rows).groupBy("ident", "kind", "subtype").agg(
        F.sum(F.col("end_byte") - F.col("start_byte")).alias("bytes"), F.min("start_byte").alias("first_byte")
    )


_CONTEXT = """
c AS (SELECT ['network', 'local', 'none'][l_linenumber % 3 + 1] AS entry_point, l_suppkey % 2 = 0 AS authenticated, ['low', 'medium', 'high', 'critical'][l_partkey % 4 + 1] AS criticality,
  l_partkey % 10 = 0 AS is_test, l_orderkey % 3 = 0 AS has_path, ['N', 'L', 'H'][l_linenumber % 3 + 1] AS pr, ['H', 'L', 'N'][l_partkey % 3 + 1] AS vc, ['H', 'L', 'N'][l_suppkey % 3 + 1] AS vi,
  ['H', 'L', 'N'][l_orderkey % 3 + 1] AS va, CASE WHEN l_linenumber = 7 THEN 'S' ELSE 'N' END AS sa FROM lineitem)
"""


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of a finding a line."""
    pick = lambda names, of: F.element_at(F.array(*map(F.lit, names)), (F.col(of) % len(names) + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        pick(("network", "local", "none"), "l_linenumber").alias("entry_point"), (F.col("l_suppkey") % 2 == 0).alias("authenticated"),
        pick(("low", "medium", "high", "critical"), "l_partkey").alias("criticality"), (F.col("l_partkey") % 10 == 0).alias("is_test"),
        (F.col("l_orderkey") % 3 == 0).alias("has_path"), pick("NLH", "l_linenumber").alias("pr"), pick("HLN", "l_partkey").alias("vc"),
        pick("HLN", "l_suppkey").alias("vi"), pick("HLN", "l_orderkey").alias("va"), F.lit("N").alias("sc"), F.lit("N").alias("si"),
        F.when(F.col("l_linenumber") == 7, "S").otherwise("N").alias("sa"),
    )


@query(f"""
WITH {_CONTEXT}, o AS (SELECT *, CASE WHEN entry_point = 'network' AND NOT authenticated THEN 9 WHEN entry_point = 'local' THEN 4 ELSE 7 END AS opportunity,
  CASE WHEN entry_point = 'network' AND NOT authenticated THEN 9 WHEN entry_point = 'local' THEN 4 ELSE 6 END AS size,
  5 - CASE WHEN is_test THEN 3 ELSE 0 END + CASE WHEN has_path THEN 1 ELSE 0 END AS exploit, CASE WHEN sa = 'S' THEN 'H' ELSE va END AS a FROM c),
f AS (SELECT criticality, round((28 + opportunity + size + exploit) / 8, 3) AS likelihood,
  (CASE WHEN vc = 'H' AND vi = 'H' AND a = 'H' THEN 18 ELSE MAP {{'H': 7, 'L': 6, 'N': 0}}[vc] + MAP {{'H': 7, 'L': 3, 'N': 0}}[vi] END
   + MAP {{'H': 7, 'L': 5, 'N': 0}}[a] + MAP {{'N': 9, 'L': 7, 'H': 1}}[pr]) / 4 AS impact FROM o),
g AS (SELECT *, CASE WHEN likelihood < 3 THEN 'low' WHEN likelihood < 6 THEN 'medium' ELSE 'high' END AS likelihood_band, CASE WHEN impact < 3 THEN 'low' WHEN impact < 6 THEN 'medium' ELSE 'high' END AS impact_band FROM f)
SELECT likelihood, impact, likelihood_band, impact_band, count(*) AS n,
  ['note', 'low', 'medium', 'high', 'critical'][list_position(['low', 'medium', 'high'], likelihood_band) + list_position(['low', 'medium', 'high'], impact_band) - 1] AS overall FROM g GROUP BY ALL
""")
def owasp_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by likelihood, impact and overall risk, from default threats and their context."""
    return rating.owasp_rated(contexts(spark, sf_dir)).groupBy("likelihood", "impact", "likelihood_band", "impact_band", "overall").agg(F.count("*").alias("n"))


@query("""
WITH c AS (SELECT round(l_discount * 100, 1) AS score, (l_linenumber % 5)::INT AS o, CASE WHEN l_suppkey % 3 > 0 THEN (l_partkey % 5)::INT END AS engine, l_orderkey % 2 = 0 AS owned, l_partkey % 7 = 0 AS is_test, l_partkey % 11 = 0 AS is_vendored, l_quantity > 25 AS says FROM lineitem),
a AS (SELECT *, CASE WHEN score >= 9 THEN 4 WHEN score >= 7 THEN 3 WHEN score >= 4 THEN 2 WHEN score >= 0.1 THEN 1 ELSE 0 END AS s FROM c),
b AS (SELECT *, CASE WHEN owned AND engine IS NOT NULL THEN engine ELSE greatest(s, o) END AS r FROM a),
d AS (SELECT *, CASE WHEN is_test OR is_vendored THEN greatest(r - 1, 0) ELSE r END AS d FROM b),
e AS (SELECT *, greatest(d, coalesce(engine, 0)) AS f FROM d),
m AS (SELECT *, CASE WHEN NOT says AND is_vendored THEN greatest(f - 1, 0) ELSE f END AS z FROM e)
SELECT ['info', 'low', 'medium', 'high', 'critical'][z + 1] AS severity, concat_ws(',', CASE WHEN owned AND engine IS NOT NULL THEN 'engine_severity' END,
  CASE WHEN is_test THEN 'test_code_downgrade' END, CASE WHEN is_vendored AND NOT is_test THEN 'vendored_downgrade' END, CASE WHEN coalesce(engine, 0) > d THEN 'engine_floor' END,
  CASE WHEN NOT says AND is_vendored THEN 'model_downgrade' END) AS steps, count(*) AS n FROM m GROUP BY ALL
""")
def policy_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severities under the strictest policy with a floor and the model's doubts."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.round(F.col("l_discount") * 100, 1).alias("score"),
        F.element_at(F.array(*map(F.lit, ("note", "low", "medium", "high", "critical"))), (F.col("l_linenumber") % 5 + 1).cast("int")).alias("overall"),
        F.when(F.col("l_suppkey") % 3 > 0, codes.severity_name(F.col("l_partkey") % 5)).alias("engine_severity"),
        F.when(F.col("l_orderkey") % 2 == 0, "secret").otherwise("code").alias("kind"), (F.col("l_partkey") % 7 == 0).alias("is_test"),
        (F.col("l_partkey") % 11 == 0).alias("is_vendored"), (F.col("l_quantity") > 25).alias("model_says_vulnerable"),
        F.when(F.col("l_partkey") % 11 == 0, "high").otherwise("medium").alias("model_confidence"),
    )
    policy = rating.Policy(source="strictest", engine_floor=True, model_down=True)
    return rating.with_severity(rows, policy).groupBy("severity", "steps").agg(F.count("*").alias("n"))


@query(f"""
WITH {_F} SELECT engine || '@unknown' AS engine, 'CWE-' || cwe AS rule_id, CASE WHEN rank >= 3 THEN 'error' WHEN rank = 2 THEN 'warning' ELSE 'note' END AS level, path, count(*) AS n, sum(line)::BIGINT AS lines FROM f GROUP BY ALL
""")
def log_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings written as logs of 1000 at most and read again."""
    f = scan_findings(spark, sf_dir)
    rows = f.select(
        "id", "engine", F.concat(F.lit("CWE-"), F.col("cwe").cast("string")).alias("rule_id"), codes.log_level(codes.severity_name(F.col("rank"))).alias("level"),
        F.lit("found").alias("message"), "path", F.col("line").alias("start_line"), F.col("line").alias("end_line"),
    )
    path = scratch(spark)
    reports.write_logs(rows, path, ["id"])
    return reports.read_logs(spark, path, lines=True).groupBy("engine", "rule_id", "level", "path").agg(F.count("*").alias("n"), F.sum("start_line").alias("lines"))


@query("""
WITH p AS (SELECT DISTINCT l_suppkey AS app, 'pkg:pypi/part-' || (l_partkey % 500) || '@1.' || (l_suppkey % 3) AS purl FROM lineitem)
SELECT app, count(*)::INT AS n, regexp_replace(substr(sha256(string_agg(purl, '' ORDER BY purl)), 1, 32), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', 'urn:uuid:\\1-\\2-\\3-\\4-\\5') AS serial FROM p GROUP BY app
""")
def bills_of_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bill of material a supplier, of the parts it delivers: its serial and its number of components."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("app"), F.lit("PyPI").alias("ecosystem"), F.concat(F.lit("Part_"), (F.col("l_partkey") % 500).cast("string")).alias("name"),
        F.concat(F.lit("1."), (F.col("l_suppkey") % 3).cast("string")).alias("version"), F.lit("runtime").alias("scope"), F.lit(True).alias("direct"),
    )
    bom = F.from_json("bom", "serialNumber string, components array<struct<purl:string>>")
    return reports.components(rows).select("app", bom.alias("b")).select("app", F.size("b.components").alias("n"), F.col("b.serialNumber").alias("serial"))


@query("""
SELECT p_partkey::VARCHAR AS key, CASE WHEN p_partkey % 3 = 0 THEN '''=' || p_name WHEN p_partkey % 3 = 1 THEN 'a "b", ' || chr(10) || p_name ELSE '' END AS cell FROM part
""")
def cell_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with formulas, quotes, line breaks and nulls, written as CSV and read again."""
    cell = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("="), F.col("p_name"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit('a "b", \n'), F.col("p_name")))
    path = scratch(spark)
    reports.write_cells(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), cell.alias("cell")), path)
    read = spark.read.csv(path, header=True, escape='"', multiLine=True, schema="key string, cell string")
    return read.select("key", F.coalesce("cell", F.lit("")).alias("cell"))
