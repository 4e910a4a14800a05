"""Findings against labels, suppressions with an end and markers in the source, and kinds of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import codes, files
from tidemark.operators import evaluation, triage
from tidemark.operators.graph import stored
from tidemark.plans.catalogue import query
from tidemark.plans.security import _F, _NAMES, scan_findings
from tidemark.sources.tables import table, values

_WEAK = [89, 943, 79, 77, 798, 1333, 611]
_FAMILY = "CASE " + " ".join(f"WHEN {{0}} IN ({', '.join(map(str, m))}) THEN '{n}'" for n, m in evaluation.FAMILIES.items()) + " ELSE 'cwe-' || {0} END"
_LABELLED = f"""
{_F}, fp AS (SELECT *, 'src/p' || ((id // 10000) % 1000000 // 40) || '.py' AS own FROM f),
r AS (SELECT id, own || CASE WHEN cwe = 5 THEN '.lock' ELSE '' END AS path, line AS start, line + rank AS "end", [{_WEAK}[id % 7 + 1], {_WEAK}[(id // 7) % 7 + 1]] AS cwes FROM fp),
t AS (SELECT o_orderkey AS no, 'L' || o_orderkey AS label, 'src/p' || (o_custkey // 30) || '.py' AS path, CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE (o_orderkey * 11) % 300 + 1 END AS line,
  CASE WHEN o_custkey % 9 = 0 THEN 0 ELSE [89, 87, 77, 259, 776][o_custkey % 5 + 1] END AS cwe, o_orderpriority LIKE '5%' AS safe FROM orders),
rf AS (SELECT r.*, unnest(list_distinct([{_FAMILY.format('cwes[1]')}, {_FAMILY.format('cwes[2]')}])) AS fam FROM r WHERE path LIKE '%.py'), tf AS (SELECT *, {_FAMILY.format('cwe')} AS fam FROM t),
b AS (SELECT rf.id, any_value(rf.path) AS path, any_value(rf.start) AS start, min((CASE WHEN line = 0 THEN 0 ELSE abs(line - start) END, no, label)) AS best FROM rf JOIN tf ON NOT safe AND rf.path = tf.path AND rf.fam = tf.fam
  AND (line = 0 OR line BETWEEN start - 3 AND "end" + 3) GROUP BY rf.id),
k AS (SELECT id, best[3] AS label, row_number() OVER (PARTITION BY best[2] ORDER BY path, start, id) AS k FROM b),
c AS (SELECT r.id, min((no, label, cwe, fam)) AS c FROM r JOIN tf ON safe AND line <> 0 AND r.path = tf.path AND line BETWEEN r.start AND r."end" WHERE r.path LIKE '%.py' GROUP BY r.id),
cc AS (SELECT c.id, c.c[2] AS label FROM c WHERE c.c[3] = 0 OR EXISTS (SELECT 1 FROM rf WHERE rf.id = c.id AND rf.fam = c.c[4])),
s AS (SELECT DISTINCT id FROM rf WHERE fam IN (SELECT fam FROM tf WHERE NOT safe)),
o AS (SELECT r.id, CASE WHEN k.k = 1 THEN 'matched' WHEN k.k > 1 THEN 'duplicate' WHEN cc.id IS NOT NULL THEN 'on_control' WHEN s.id IS NOT NULL THEN 'false_positive' ELSE 'out_of_scope' END AS outcome, coalesce(k.label, cc.label) AS label
  FROM r LEFT JOIN k ON k.id = r.id LEFT JOIN cc ON cc.id = r.id LEFT JOIN s ON s.id = r.id)
"""


def labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(findings, labels), as dense at any size: findings of two weaknesses each, a fifth of them in lock files, and a label an order, a fifth of them controls."""
    f = scan_findings(spark, sf_dir)
    weak = F.array(*map(F.lit, _WEAK))
    number = lambda e: F.element_at(weak, (F.expr(e) % 7 + 1).cast("int"))
    path = F.concat(F.lit("src/p"), F.expr("cast((id div 10000) % 1000000 div 40 AS string)"), F.lit(".py"), F.when(F.col("cwe") == 5, ".lock").otherwise(""))
    found = f.select("id", path.alias("path"), F.col("line").alias("start"), (F.col("line") + F.col("rank")).alias("end"), F.array(number("id"), number("id div 7")).alias("cwes"))
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    labels = table(spark, sf_dir, "orders").select(
        key.alias("no"), F.concat(F.lit("L"), key.cast("string")).alias("label"), F.concat(F.lit("src/p"), F.floor(customer / 30).cast("string"), F.lit(".py")).alias("path"),
        F.when(key % 97 == 0, 0).otherwise(key * 11 % 300 + 1).alias("line"), F.when(customer % 9 == 0, 0).otherwise(F.element_at(F.array(*map(F.lit, (89, 87, 77, 259, 776))), (customer % 5 + 1).cast("int"))).alias("cwe"),
        F.col("o_orderpriority").startswith("5").alias("safe"),
    )
    return found, labels


@query(f"WITH {_LABELLED} SELECT id, outcome, label FROM o")
def labelled_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each finding is, held against labels by family, with controls and scope."""
    return evaluation.held_against(*labelled(spark, sf_dir))


@query(f"""
WITH {_LABELLED}, m AS (SELECT count(*) FILTER (WHERE outcome = 'matched') AS matched, count(*) FILTER (WHERE outcome IN ('false_positive', 'on_control')) AS false_positives, count(*) FILTER (WHERE outcome = 'on_control') AS on_controls,
  count(*) FILTER (WHERE outcome = 'duplicate') AS duplicates, count(*) FILTER (WHERE outcome = 'out_of_scope') AS out_of_scope FROM o),
x AS (SELECT count(*) AS missed FROM t WHERE NOT safe AND label NOT IN (SELECT label FROM o WHERE outcome IN ('matched', 'duplicate')))
SELECT *, round(matched / (matched + false_positives), 6) AS precision, round(matched / (matched + missed), 6) AS recall, round(2 * matched / (2 * matched + false_positives + missed), 6) AS f1 FROM m, x
""")
def labelled_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the findings meet the labels."""
    found, labels = labelled(spark, sf_dir)
    return evaluation.rates(labels, stored(evaluation.held_against(found, labels)))


_EXPIRING = [(1, "CWE-2", "src/p1*", "generated", "2024-06-30"), (2, "A", "src/p?.py", "accepted", "2024-06-29"), (3, " N ", None, "by design", None), (4, "*", "src/p49.py", "  ", None), (5, "", "*", "no rule", None), (6, "R", "src/p2*", "old", "2031-01-01")]


@query(f"""
WITH {_F}, m AS (SELECT id, min(CASE WHEN cwe = 2 AND path GLOB 'src/p1*' THEN 1 WHEN engine = 'N' THEN 3 WHEN engine = 'R' AND path GLOB 'src/p2*' THEN 6 END) AS no FROM f GROUP BY id)
SELECT id, no AS rule_no, CASE no WHEN 1 THEN 'generated' WHEN 3 THEN 'by design' ELSE 'old' END AS why FROM m WHERE no IS NOT NULL
""")
def expiring_suppressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that rules cover which are justified and still hold on a day."""
    rules = values(spark, _EXPIRING, "rule_no int, rule string, rule_path string, why string, expires string").withColumn("expires", F.col("expires").cast("date"))
    return triage.suppressed(scan_findings(spark, sf_dir).withColumnRenamed("engine", "rule_id"), triage.current_rules(rules, F.lit("2024-06-30").cast("date")))


_SOURCES = """
d AS (SELECT doc_id, source || '/' || doc_id || '.py' AS path, text || chr(10) || ['# tide:ignore -- ok', 'x = 1  // tide:ignore[CWE-' || (doc_id % 3) || ', B*]: known', 'y tide:ignore', '; tide:ignore[A] - why */', 'plain'][doc_id % 5 + 1] || chr(10) || 'last' AS text FROM documents),
n AS (SELECT *, len(string_split(text, chr(10))) AS lines FROM d),
f AS (SELECT doc_id * 2 + k AS id, path, lines - 1 + k AS line, ['A', 'B1', 'C'][doc_id % 3 + 1] AS rule_id, (doc_id // 3) % 3 AS cwe, doc_id, k FROM n, range(2) t(k))
"""


@query(f"""
WITH {_SOURCES} SELECT id, CASE doc_id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'known' WHEN 3 THEN 'why' END AS why FROM f
WHERE CASE doc_id % 5 WHEN 0 THEN true WHEN 1 THEN k = 0 AND (cwe = doc_id % 3 OR rule_id LIKE 'B%') WHEN 2 THEN k = 0 WHEN 3 THEN rule_id = 'A' ELSE false END
""")
def inline_suppressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on the last two lines of documents that a marker there covers."""
    doc = F.col("doc_id")
    end = F.element_at(
        F.array(F.lit("# tide:ignore -- ok"), F.concat(F.lit("x = 1  // tide:ignore[CWE-"), (doc % 3).cast("string"), F.lit(", B*]: known")), F.lit("y tide:ignore"), F.lit("; tide:ignore[A] - why */"), F.lit("plain")), (doc % 5 + 1).cast("int")
    )
    path = F.concat("source", F.lit("/"), doc.cast("string"), F.lit(".py"))
    texts = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.concat("text", F.lit("\n"), end, F.lit("\nlast")).alias("text"))
    rule = F.element_at(F.array(F.lit("A"), F.lit("B1"), F.lit("C")), (doc % 3 + 1).cast("int"))
    found = texts.select("doc_id", "path", F.size(F.split("text", "\n", -1)).alias("lines"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).select(
        (doc * 2 + F.col("k")).alias("id"), "path", (F.col("lines") - 1 + F.col("k")).alias("line"), rule.alias("rule_id"), (F.floor(doc / 3) % 3).alias("cwe")
    )
    return triage.marked_inline(found, texts.select("path", "text"), "tide")


@query(f"""
WITH {_F} SELECT id, {_NAMES}[rank + 1] AS severity, path, line FROM f
WHERE rank >= 3 AND status = 'open' AND cwe = 3 AND contains(path, 'p1') AND ('u' || (id % 7)) = 'u2' AND (contains(path, 'p11') OR contains(id::VARCHAR, 'p11') OR contains(engine, 'p11'))
""")
def chosen_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by criteria that a caller gives."""
    rows = scan_findings(spark, sf_dir).withColumns({"severity": codes.severity_name(F.col("rank")), "assignee": F.concat(F.lit("u"), (F.col("id") % 7).cast("string"))})
    return triage.chosen(rows, me="u2", severity=" High, critical,,", status="open", cwe="CWE-3", path="p1", assignee="me", q="P11").select("id", "severity", "path", "line")


@query(r"""
WITH d AS (SELECT doc_id, ['src/a.py', 'vendor/b.js', 'x/c.min.JS', 'db/migrations/1.sql', 'api_pb2.py', 'lib/node_modules/z.ts'][doc_id % 6 + 1] AS path,
  CASE doc_id % 7 WHEN 0 THEN '// Code generated by x' || chr(10) || text WHEN 1 THEN replace(text, ' ', ';') WHEN 2 THEN replace(text, chr(10), ' ') WHEN 3 THEN text || chr(10) || chr(0) ELSE text END AS text FROM documents),
l AS (SELECT *, string_split(text, chr(10)) AS lines FROM d),
m AS (SELECT *, list_sort(list_transform(lines[1:200], lambda x: length(x))) AS n, len(lines) - CASE WHEN text = '' OR text[-1] = chr(10) THEN 1 ELSE 0 END AS rows FROM l)
SELECT doc_id, contains(text, chr(0)) AND strpos(text, chr(0)) <= 8192 AND octet_length(encode(split_part(text, chr(0), 1))) < 8192 AS is_binary,
  path ILIKE '%.min.js' OR n[len(n) // 2 + 1] > 500 OR (rows > 0 AND length(text) - length(replace(text, ';', '')) > 5 * rows) AS is_minified,
  path IN ('db/migrations/1.sql', 'api_pb2.py') OR len(list_filter(lines[1:5], lambda x: regexp_matches(x, '@generated|Code generated by|DO NOT EDIT|Autogenerated'))) > 0 AS is_generated, path LIKE 'vendor/%' OR path LIKE '%/node_modules/%' AS is_vendored FROM m
""")
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents, under made paths, are binary, minified, generated or other people's."""
    paths = F.array(*map(F.lit, ("src/a.py", "vendor/b.js", "x/c.min.JS", "db/migrations/1.sql", "api_pb2.py", "lib/node_modules/z.ts")))
    which = F.col("doc_id") % 7
    text = (
        F.when(which == 0, F.concat(F.lit("// Code generated by x\n"), F.col("text"))).when(which == 1, F.replace("text", F.lit(" "), F.lit(";"))).when(which == 2, F.replace("text", F.lit("\n"), F.lit(" ")))
        .when(which == 3, F.concat("text", F.lit("\n\x00"))).otherwise(F.col("text"))
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", F.element_at(paths, (F.col("doc_id") % 6 + 1).cast("int")).alias("path"), text.alias("text"))
    p, t = F.col("path"), F.col("text")
    return rows.select(
        "doc_id", files.is_binary(F.encode(t, "utf-8")).alias("is_binary"), files.is_minified(p, t).alias("is_minified"), files.is_generated(p, t).alias("is_generated"), files.is_vendored(p).alias("is_vendored")
    )
