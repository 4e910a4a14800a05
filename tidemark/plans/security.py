"""Findings of scans: filters, gates, deltas, triage, matching, votes, summaries and checks.

Findings are the lines of the order table: the SQL of each query has the same projection under the name f.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import codes
from tidemark.operators import matching, triage
from tidemark.operators.graph import stored
from tidemark.plans.catalogue import query
from tidemark.sources.tables import scratch, table, values
from tidemark.streaming import ledgers

_F = """
f AS (SELECT ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS id, l_orderkey % 2 AS scan, (l_partkey % 1000) * 10 + l_linenumber AS fingerprint,
  'src/p' || (l_partkey % 50) || '.py' AS path, (l_orderkey * 7 + l_linenumber * 13) % 300 + 1 AS line, l_returnflag AS engine,
  l_linenumber % 5 + 1 AS cwe, least(4, floor(l_quantity / 10.01))::INT AS rank, CASE WHEN l_linestatus = 'O' THEN 'open' ELSE 'fixed' END AS status FROM lineitem)
"""
_NAMES = "['info', 'low', 'medium', 'high', 'critical']"


def scan_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, scan, fingerprint, path, line, engine, cwe, rank, status) of each line."""
    return table(spark, sf_dir, "lineitem").select(
        (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("id"),
        (F.col("l_orderkey") % 2).alias("scan"),
        ((F.col("l_partkey") % 1000) * 10 + F.col("l_linenumber")).alias("fingerprint"),
        F.concat(F.lit("src/p"), (F.col("l_partkey") % 50).cast("string"), F.lit(".py")).alias("path"),
        ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 300 + 1).alias("line"),
        F.col("l_returnflag").alias("engine"),
        (F.col("l_linenumber") % 5 + 1).alias("cwe"),
        F.least(F.lit(4), F.floor(F.col("l_quantity") / 10.01)).cast("int").alias("rank"),
        F.when(F.col("l_linestatus") == "O", "open").otherwise("fixed").alias("status"),
    )


# --- filters -----------------------------------------------------------------------------------------------


@query(f"""
WITH {_F} SELECT id, path, line FROM f
WHERE list_contains(['high', 'critical'], {_NAMES}[rank + 1]) AND status IN ('open') AND cwe = 3 AND path LIKE '%p1%' AND (path ILIKE '%SRC%' OR engine ILIKE '%SRC%')
""")
def finding_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of: severity and status in comma lists, a weakness, a part of the path, and free text over several columns."""
    rows = scan_findings(spark, sf_dir)
    wanted = codes.comma_list(F.lit(" High, critical,,"))
    text = F.lit("%SRC%")
    return rows.where(
        F.array_contains(wanted, codes.severity_name(F.col("rank"))) & F.array_contains(codes.comma_list(F.lit("open")), F.col("status"))
        & (F.col("cwe") == 3) & F.col("path").contains("p1") & (F.ilike(F.col("path"), text) | F.ilike(F.col("engine"), text))
    ).select("id", "path", "line")


@query(f"""
WITH {_F} SELECT scan, count(*) FILTER (WHERE status IN ('open', 'confirmed') AND rank >= 3) AS counted,
  {_NAMES}[max(rank) FILTER (WHERE status IN ('open', 'confirmed') AND rank >= 3) + 1] AS worst,
  count(*) FILTER (WHERE NOT (status IN ('open', 'confirmed') AND rank >= 3)) AS not_counted FROM f GROUP BY scan
""")
def severity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open findings at or above the severity that fails a scan, the worst of them, and how many don't count."""
    fails = F.col("status").isin("open", "confirmed") & (F.col("rank") >= codes.SEVERITIES.index("high"))
    return scan_findings(spark, sf_dir).groupBy("scan").agg(
        F.count_if(fails).alias("counted"),
        codes.severity_name(F.max(F.when(fails, F.col("rank")))).alias("worst"),
        F.count_if(~fails).alias("not_counted"),
    )


_HOSTS = ["example.com", "*.example.com", "*.org"]


@query("""
WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM pages)
SELECT page_id, host, (host = 'example.com' OR ends_with(host, '.example.com') OR ends_with(host, '.org')) AS allowed FROM h
""")
def host_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1))
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), codes.host_allowed(host, _HOSTS).alias("allowed"))


_RULES = [(1, "CWE-2", "src/p1*", "generated"), (2, "A", "src/p?.py", "accepted"), (3, "[R]", "*", "never"), (4, "*", "src/p49.py", "vendored"), (5, "N*", "*7.py", "test code")]


@query(f"""
WITH {_F}, r(no, rule, path, why) AS (VALUES {", ".join(f"({n}, '{a}', '{b}', '{c}')" for n, a, b, c in _RULES)}),
m AS (SELECT f.id, min(r.no) AS no FROM f JOIN r ON (r.rule = '*' OR r.rule = f.engine OR (r.rule LIKE 'CWE-%' AND r.rule[5:] = f.cwe::VARCHAR) OR
  (r.rule NOT LIKE 'CWE-%' AND r.rule <> '[R]' AND f.engine GLOB r.rule)) AND f.path GLOB r.path GROUP BY f.id)
SELECT m.id, r.no AS rule_no, r.why FROM m JOIN r ON m.no = r.no
""")
def suppressed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that a rule of the suppressions file covers: the first one counts.  The file's rules are few and broadcast."""
    rules = values(spark, _RULES, "rule_no int, rule string, rule_path string, why string")
    return triage.suppressed(scan_findings(spark, sf_dir).withColumnRenamed("engine", "rule_id"), rules)


@query("""
WITH r AS (SELECT l_orderkey AS k, l_linenumber AS n, l_linenumber * 10 AS s, l_linenumber * 10 + l_quantity::INT AS e FROM lineitem)
SELECT a.k, a.n AS a, b.n AS b, (b.s <= a.e AND a.s <= b.e) AS overlaps, (a.s <= b.s AND b.e <= a.e) AS holds
FROM r a JOIN r b ON a.k = b.k AND a.n < b.n WHERE b.s <= a.e AND a.s <= b.e
""")
def region_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of lines that share a line, and whether the first holds the other.  An order has few lines; they meet inside the row."""
    line = F.struct(
        F.col("l_linenumber").alias("n"), (F.col("l_linenumber") * 10).alias("s"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int")).alias("e")
    )
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list(line)).alias("rows"))
    pairs = rows.select("k", F.explode("rows").alias("x"), "rows").select("k", "x", F.explode("rows").alias("y")).where("x.n < y.n")
    shares = (F.col("y.s") <= F.col("x.e")) & (F.col("x.s") <= F.col("y.e"))
    holds = (F.col("x.s") <= F.col("y.s")) & (F.col("y.e") <= F.col("x.e"))
    return pairs.where(shares).select("k", F.col("x.n").alias("a"), F.col("y.n").alias("b"), shares.alias("overlaps"), holds.alias("holds"))


# --- deltas, triage and matching -----------------------------------------------------------------------------

_TWO = """
o AS (SELECT fingerprint, min(id) AS id, max(rank) AS rank FROM f WHERE scan = 0 GROUP BY fingerprint),
n AS (SELECT fingerprint, min(id) AS id, max(rank) AS rank, min(status) AS status FROM f WHERE scan = 1 GROUP BY fingerprint)
"""


def _two_scans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = scan_findings(spark, sf_dir)
    one = lambda s: rows.where(F.col("scan") == s).groupBy("fingerprint").agg(F.min("id").alias("id"), F.max("rank").alias("rank"), F.min("status").alias("status"))
    return one(0), one(1)


@query(f"""
WITH {_F}, {_TWO} SELECT coalesce(n.fingerprint, o.fingerprint) AS fingerprint, CASE WHEN o.id IS NULL THEN 'new' WHEN n.id IS NULL OR n.status = 'fixed' THEN 'fixed'
  WHEN n.rank > o.rank THEN 'regressed' ELSE 'unchanged' END AS state, o.rank AS old_rank, n.rank AS new_rank FROM o FULL JOIN n ON o.fingerprint = n.fingerprint
""")
def delta_regressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans by fingerprint: new, fixed (absent now, or marked so), regressed (a higher severity) and unchanged."""
    return triage.delta_states(*_two_scans(spark, sf_dir))


@query(f"""
WITH {_F}, {_TWO} SELECT n.id AS finding, CASE WHEN o.id IS NULL THEN 'new' ELSE 'unchanged' END AS state FROM n LEFT JOIN o ON o.fingerprint = n.fingerprint
UNION ALL SELECT o.id, 'fixed' FROM o WHERE o.fingerprint NOT IN (SELECT fingerprint FROM n)
""")
def baseline_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each finding against a baseline scan, and the baseline's findings that are gone."""
    old, new = _two_scans(spark, sf_dir)
    both = old.select("fingerprint", F.col("id").alias("was")).join(new.select("fingerprint", "id"), "fingerprint", "full_outer")
    state = F.when(F.col("was").isNull(), "new").when(F.col("id").isNull(), "fixed").otherwise("unchanged")
    return both.select(F.coalesce("id", "was").alias("finding"), state.alias("state"))


@query(f"""
WITH {_F}, {_TWO}, t AS (SELECT fingerprint, ['confirmed', 'false_positive', 'accepted_risk', 'fixed', 'open'][(id % 5) + 1] AS status,
  CASE WHEN id % 3 = 0 THEN 'u' || (id % 7) END AS assignee FROM o)
SELECT n.id AS finding, 'open' AS from_status, CASE WHEN t.status IN ('confirmed', 'false_positive', 'accepted_risk') THEN t.status ELSE 'open' END AS to_status, t.assignee
FROM n JOIN t ON n.fingerprint = t.fingerprint WHERE n.status = 'open' AND (t.status IN ('confirmed', 'false_positive', 'accepted_risk') OR t.assignee IS NOT NULL)
""")
def carried_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History rows of open findings that keep the decision or assignee of the scan before."""
    old, new = _two_scans(spark, sf_dir)
    names = F.array(*map(F.lit, ("confirmed", "false_positive", "accepted_risk", "fixed", "open")))
    decided = old.select(
        "fingerprint",
        F.element_at(names, (F.col("id") % 5 + 1).cast("int")).alias("decision"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("u"), (F.col("id") % 7).cast("string"))).alias("assignee"),
    )
    return triage.carried(decided, new)


@query(f"""
WITH {_F}, t AS (SELECT o_orderkey AS label, 'src/p' || (o_custkey % 50) || '.py' AS path, (o_orderkey * 11) % 300 + 1 AS line, o_custkey % 5 + 1 AS cwe FROM orders),
c AS (SELECT f.id, f.path, f.line, t.label, row_number() OVER (PARTITION BY f.id ORDER BY abs(t.line - f.line), t.label) AS r
  FROM f JOIN t ON f.path = t.path AND f.cwe = t.cwe AND t.line BETWEEN f.line - 3 AND f.line + 3),
b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY path, line, id) AS k FROM c WHERE r = 1)
SELECT f.id, b.label, CASE WHEN b.id IS NULL THEN 'false_positive' WHEN b.k = 1 THEN 'matched' ELSE 'duplicate' END AS outcome FROM f LEFT JOIN b ON f.id = b.id
""")
def label_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each finding takes the nearest label of its file and weakness within three lines; a label's first finding matches, others are duplicates."""
    orders = table(spark, sf_dir, "orders")
    labels = orders.select(
        F.col("o_orderkey").alias("label"),
        F.concat(F.lit("src/p"), (F.col("o_custkey") % 50).cast("string"), F.lit(".py")).alias("path"),
        ((F.col("o_orderkey") * 11) % 300 + 1).alias("line"),
        (F.col("o_custkey") % 5 + 1).alias("cwe"),
    )
    return triage.matched(scan_findings(spark, sf_dir), labels, 3)


@query("""
WITH c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view')
SELECT p.event_id AS scan, (SELECT max_by(c.event_id, (c.ts, -c.event_id)) FROM c WHERE c.user_id = p.user_id AND date_trunc('second', c.ts) <= date_trunc('second', p.ts)) AS previous FROM p
""")
def previous_scan_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each scan of a project the latest completed one of another table that ended by then: an as-of join."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"))
    found = matching.nearest_before(rows.where("event_type = 'view'"), rows.where("event_type = 'click'"), "user_id", "t", "event_id", 1 << 40, "ts", outer=True)
    return found.select(F.col("left_id").alias("scan"), F.col("right_id").alias("previous"))


_CHAIN_SQL = """
WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
b AS (SELECT user_id, n, ts, sha256(event_id || '|' || event_type) AS own, CASE WHEN event_id % 89 = 0 THEN 'x' ELSE sha256(event_id || '|' || event_type) END AS entry_hash,
  CASE WHEN event_id % 101 = 0 THEN n + 1 ELSE n END AS seq, event_id FROM e),
l AS (SELECT *, CASE WHEN event_id % 97 = 0 THEN 'y' ELSE coalesce(lag(entry_hash) OVER w, repeat('0', 64)) END AS prev_hash, lag(entry_hash) OVER w AS before,
  lag(seq) OVER w AS before_seq, lag(ts) OVER w AS before_ts FROM b WINDOW w AS (PARTITION BY user_id ORDER BY n)),
c AS (SELECT *, CASE WHEN entry_hash <> own THEN 'entry hash' WHEN before IS NULL AND (seq <> 1 OR prev_hash <> repeat('0', 64)) THEN 'genesis'
  WHEN before IS NOT NULL AND seq <> before_seq + 1 THEN 'sequence' WHEN before IS NOT NULL AND prev_hash <> before THEN 'previous hash'
  WHEN before IS NOT NULL AND ts < before_ts THEN 'time' END AS reason FROM l)
SELECT user_id, count(*) AS entries, count(reason) = 0 AS ok, min(seq) FILTER (WHERE reason IS NOT NULL) AS first_bad, min_by(reason, n) FILTER (WHERE reason IS NOT NULL) AS reason FROM c GROUP BY user_id
"""


def _ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledgers of events, one a user, with planted faults."""
    place = Window.partitionBy("user_id").orderBy("event_id")
    own = F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "event_type"), 256)
    rows = table(spark, sf_dir, "events").withColumn("n", F.row_number().over(place)).select(
        "user_id",
        "n",
        "event_id",
        "ts",
        F.concat_ws("|", F.col("event_id").cast("string"), "event_type").alias("body"),
        F.when(F.col("event_id") % 89 == 0, "x").otherwise(own).alias("entry_hash"),
        F.when(F.col("event_id") % 101 == 0, F.col("n") + 1).otherwise(F.col("n")).cast("long").alias("seq"),
    )
    linked = F.coalesce(F.lag("entry_hash").over(place), F.lit("0" * 64))
    return rows.withColumn("prev_hash", F.when(F.col("event_id") % 97 == 0, "y").otherwise(linked))


@query(_CHAIN_SQL)
def hash_chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the ledgers' verification: genesis, sequence, hashes and time."""
    return triage.verified_chains(_ledgers(spark, sf_dir), "user_id", "n")


@query(_CHAIN_SQL)
def ledger_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same report from a stream of the ledgers, which comes in three parts, with a stop after each."""
    entries = stored(_ledgers(spark, sf_dir))
    low, high = entries.approxQuantile("event_id", [1 / 3, 2 / 3], 0.01)
    folder = scratch(spark)
    for part in (F.col("event_id") <= low, (F.col("event_id") > low) & (F.col("event_id") <= high), F.col("event_id") > high):
        entries.where(part).write.mode("append").parquet(f"{folder}/in")
        found = ledgers.run_to_end(spark.readStream.schema(entries.schema).parquet(f"{folder}/in"), "user_id", "n", f"{folder}/run")
    return found


@query(f"""
WITH {_F} SELECT id, row_number() OVER (PARTITION BY scan, path ORDER BY rank DESC, line, id) AS place FROM f
""")
def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in a file's report: severity, then line, then id."""
    return scan_findings(spark, sf_dir).select("id", F.row_number().over(Window.partitionBy("scan", "path").orderBy(F.desc("rank"), "line", "id")).cast("long").alias("place"))


@query(f"""
WITH {_F} SELECT id, path, line, total FROM (SELECT *, count(*) OVER () AS total FROM f WHERE rank >= 3) ORDER BY rank DESC, path, line, id LIMIT 25 OFFSET 50
""")
def findings_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of 25 findings, and how many there are in all: two jobs, of which only a count is whole."""
    return triage.page(scan_findings(spark, sf_dir).where("rank >= 3"), [F.desc("rank"), F.col("path"), F.col("line"), F.col("id")], 50, 25).select("id", "path", "line", "total")


@query(f"""
WITH {_F} SELECT scan, path, cwe, line, max(id) AS id FROM f GROUP BY scan, path, cwe, line
""")
def last_issue_per_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of issues of one rule on one line the last stays."""
    return scan_findings(spark, sf_dir).groupBy("scan", "path", "cwe", "line").agg(F.max("id").alias("id"))


# --- votes and summaries -------------------------------------------------------------------------------------


@query("""
WITH v AS (SELECT user_id, event_id, CASE WHEN value > 60 THEN true WHEN value < 40 THEN false END AS says, (event_id % 3)::INT AS conf FROM events),
c AS (SELECT user_id, count(*) AS samples, count(*) FILTER (WHERE says) AS yes, count(*) FILTER (WHERE NOT says) AS no,
  max(conf) FILTER (WHERE says) AS cy, max(conf) FILTER (WHERE NOT says) AS cn FROM v GROUP BY user_id)
SELECT user_id, samples, yes, no, samples - yes - no AS abstained, yes = no AND yes > 0 AS tie, CASE WHEN yes + no > 0 THEN yes >= no END AS vulnerable,
  CASE WHEN yes + no = 0 THEN 0.0 WHEN yes = no THEN 0.5 ELSE round(greatest(yes, no)::DOUBLE / (yes + no), 6) END AS agreement,
  CASE WHEN yes + no > 0 THEN ['low', 'medium', 'high'][CASE WHEN yes = no THEN 1 WHEN yes > no THEN cy + 1 ELSE cn + 1 END] END AS confidence FROM c
""")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of several samples made one: the majority's, with its agreement; a tie is vulnerable, of low confidence."""
    says = F.when(F.col("value") > 60, True).when(F.col("value") < 40, False)
    rows = table(spark, sf_dir, "events").select("user_id", says.alias("says"), (F.col("event_id") % 3).cast("int").alias("level"))
    return triage.votes(rows, "user_id")


@query(f"""
WITH {_F}, s AS (SELECT unnest([0, 1]) AS scan), r AS (SELECT unnest(range(5))::INT AS rank), c AS (SELECT scan, rank, count(*) AS n, count(*) FILTER (WHERE status = 'open') AS o FROM f GROUP BY ALL)
SELECT s.scan::BIGINT AS scan, {_NAMES}[r.rank + 1] AS severity, coalesce(c.n, 0) AS findings, coalesce(c.o, 0) AS open_findings,
  (SELECT count(*) FROM f WHERE f.scan = s.scan) AS total FROM s CROSS JOIN r LEFT JOIN c ON c.scan = s.scan AND c.rank = r.rank
""")
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of each scan by severity, all five of them, with the scan's total: counted once, zeros filled in the row."""
    rows = scan_findings(spark, sf_dir)
    counts = rows.groupBy("scan").agg(
        F.count("*").alias("total"),
        F.array(*(F.struct(F.lit(name).alias("severity"), F.count_if(F.col("rank") == i).alias("findings"), F.count_if((F.col("rank") == i) & (F.col("status") == "open")).alias("open_findings")) for i, name in enumerate(codes.SEVERITIES))).alias("each"),
    )
    return counts.select("scan", F.inline("each"), "total")


@query(f"""
WITH {_F}, c AS (SELECT DISTINCT fingerprint, engine FROM f) SELECT fingerprint % 10 AS category, engine, count(*) AS n FROM c GROUP BY ALL
""")
def category_by_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of each category by every engine that reports them."""
    return scan_findings(spark, sf_dir).select("fingerprint", "engine").distinct().groupBy((F.col("fingerprint") % 10).alias("category"), "engine").agg(F.count("*").alias("n"))


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _TABLES))
def table_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = None
    for t in _TABLES:
        part = table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
        found = part if found is None else found.union(part)
    return found


@query("""
WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), t AS (SELECT count(*) FILTER (WHERE lang = 'en') AS own, count(*) FILTER (WHERE lang <> 'en') AS other FROM w),
c AS (SELECT word AS term, count(*) FILTER (WHERE lang = 'en') AS occurrences, count(*) FILTER (WHERE lang <> 'en') AS outside FROM w WHERE length(word) >= 4 GROUP BY word),
s AS (SELECT term, occurrences, round(ln((occurrences::DOUBLE / own) / (greatest(outside, 1)::DOUBLE / other)), 6) AS score FROM c, t WHERE occurrences >= 5)
SELECT term, occurrences, score FROM s WHERE score >= 1.0 ORDER BY score DESC, occurrences DESC, term LIMIT 200
""")
def term_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of English documents that are telling against all others: a least count and score, then ranked by score."""
    return triage.mined_terms(table(spark, sf_dir, "documents"), F.col("lang") == "en", 5, 1.0, 200)


@query("""
WITH s AS (SELECT event_id, ts, event_type, user_id % 4 AS sev FROM events), d AS (SELECT *, [7, 30, 60, 90][sev::INT + 1] AS days FROM s),
x AS (SELECT *, ts + to_days(days::INT) AS due, TIMESTAMP '2024-02-15 00:00:00' AS now FROM d)
SELECT event_id, due, CASE WHEN event_type = 'purchase' THEN NULL WHEN now > due THEN 'overdue' WHEN now > due - to_days(greatest(1, days // 5)::INT) THEN 'due_soon' ELSE 'on_track' END AS state FROM x
""")
def sla_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding's due date by its severity's days, and its state: closed ones have none."""
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", (F.col("user_id") % 4 + 1).cast("int").alias("severity"))
    return triage.sla(rows, "ts", "severity", [7, 30, 60, 90], F.col("event_type") == "purchase", "2024-02-15 00:00:00").select("event_id", "due", "state")


# --- levels, names and previews --------------------------------------------------------------------------------


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, least(10, round(l_quantity / 5, 1)) AS score, least(9, l_discount * 90) AS owasp, ['low', 'medium', 'high'][l_linenumber % 3 + 1] AS conf FROM lineitem),
l AS (SELECT *, CASE WHEN score <= 0 THEN 1 WHEN score < 4 THEN 2 WHEN score < 7 THEN 3 WHEN score < 9 THEN 4 ELSE 5 END AS impact,
  CASE WHEN conf = 'low' THEN greatest(1, least(5, greatest(1, ceil(owasp / 1.8)::INT)) - 1) ELSE least(5, greatest(1, ceil(owasp / 1.8)::INT)) END AS likelihood FROM p)
SELECT impact, likelihood, CASE WHEN impact * likelihood <= 4 THEN 'low' WHEN impact * likelihood <= 9 THEN 'medium' WHEN impact * likelihood <= 16 THEN 'high' ELSE 'critical' END AS label,
  count(*) AS n FROM l GROUP BY ALL
""")
def risk_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the five-by-five matrix: levels from a score, a likelihood and a confidence."""
    confidence = F.element_at(F.array(*map(F.lit, codes.CONFIDENCES)), (F.col("l_linenumber") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(
        codes.impact_level(F.least(F.lit(10.0), F.round(F.col("l_quantity") / 5, 1))).alias("impact"),
        codes.likelihood_level(F.least(F.lit(9.0), F.col("l_discount") * 90), confidence).alias("likelihood"),
    )
    counted = rows.groupBy("impact", "likelihood").agg(F.count("*").alias("n"))
    return counted.withColumn("label", codes.matrix_label(F.col("likelihood"), F.col("impact")))


@query(f"""
WITH {_F} SELECT rank, {_NAMES}[rank + 1] AS severity, {_NAMES}[greatest(rank - 1, 0) + 1] AS stepped, CASE WHEN rank >= 3 THEN 'error' WHEN rank = 2 THEN 'warning' ELSE 'note' END AS level,
  CASE WHEN rank < 2 THEN 'medium' ELSE 'high' END AS bumped, count(*) AS n FROM f GROUP BY ALL
""")
def severity_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severities with the one below, the level of static-analysis logs, and a confidence raised where engines agree."""
    counted = scan_findings(spark, sf_dir).groupBy("rank").agg(F.count("*").alias("n"))
    name = codes.severity_name(F.col("rank"))
    confidence = F.when(F.col("rank") < 1, F.lit(None)).when(F.col("rank") < 2, "low").otherwise("medium")
    return counted.select("rank", name.alias("severity"), codes.severity_name(codes.step_down(F.col("rank"))).alias("stepped"), codes.log_level(name).alias("level"), codes.bumped(confidence).alias("bumped"), "n")


@query("""
WITH c AS (SELECT doc_id, text, text[:59] AS head FROM documents), w AS (SELECT *, length(head) - instr(reverse(head), ' ') AS place FROM c)
SELECT doc_id, CASE WHEN length(text) < 12 THEN '****' ELSE text[:2] || '******' END || ' (' || length(text) || ' chars)' AS preview, ((2 * length(text) + 6) // 7)::BIGINT AS tokens,
  CASE WHEN length(text) <= 60 THEN text ELSE regexp_replace(CASE WHEN contains(head, ' ') AND place > 30 THEN head[:place] ELSE head END, '[ \\t,;:.]+$', '') || '…' END AS short FROM w
""")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be shown of a text: two characters and its length, its tokens, and its beginning, cut between words."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", codes.masked(text).alias("preview"), codes.token_estimate(text).alias("tokens"), codes.cut_at_word(text, 60).alias("short")
    )


@query("""
WITH n AS (SELECT doc_id, string_split(replace(text, chr(13), ''), chr(10)) AS lines FROM documents),
m AS (SELECT doc_id, array_to_string(list_filter(list_transform(lines, lambda x: trim(regexp_replace(x, '[ \\t\\x0b\\f]+', ' ', 'g'))), lambda x: x <> '')[:50], chr(10)) AS s FROM n)
SELECT doc_id, sha256(s) AS hash, length(s) AS chars FROM m
""")
def snippet_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = codes.snippet(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text, 256).alias("hash"), F.char_length(text).cast("long").alias("chars"))


@query("""
SELECT doc_id, CASE WHEN regexp_matches(t, '^[=+@\\-\\t\\r]') THEN '''' || t ELSE t END AS cell FROM (SELECT doc_id, (['', '=', '+', '@', '-', chr(9)])[doc_id % 6 + 1] || source AS t FROM documents)
""")
def safe_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a table export, none of which a spreadsheet would run."""
    start = F.element_at(F.array(*map(F.lit, ("", "=", "+", "@", "-", "\t"))), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", codes.safe_cell(F.concat(start, F.col("source"))).alias("cell"))


def _literal(v: object) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


_AFFECTED = [("Brand#11", "1.0.0", "1.2.0", "ADV-1"), ("Brand#12", "0", "2.10.0", "ADV-2"), ("Brand#22", "1.9", None, "ADV-3"), ("Brand#33", "2.2.1", "2.3", "ADV-4")]


@query(f"""
WITH v AS (SELECT p_partkey, p_brand, [p_size % 3, p_size % 12, p_partkey % 4] AS v FROM part), a(brand, introduced, fixed, advisory) AS (VALUES {", ".join(f"('{b}', {[int(x) for x in i.split('.')]}, {[int(x) for x in f.split('.')] if f else 'NULL'}, '{n}')" for b, i, f, n in _AFFECTED)})
SELECT p_partkey, advisory FROM v JOIN a ON p_brand = brand AND v >= introduced AND (fixed IS NULL OR v < fixed)
""")
def vulnerable_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components whose version lies in an advisory's range: an equi-join on the name, then versions as arrays of numbers."""
    version = F.concat_ws(".", (F.col("p_size") % 3).cast("string"), (F.col("p_size") % 12).cast("string"), (F.col("p_partkey") % 4).cast("string"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("name"), version.alias("version"))
    ranges = values(spark, _AFFECTED, "name string, introduced string, fixed string, advisory string")
    return triage.affected(parts, ranges).select("p_partkey", "advisory")


@query("""
WITH o AS (SELECT doc_id AS path, sha256(text) AS hash FROM documents WHERE doc_id % 11 <> 3), n AS (SELECT doc_id AS path, sha256(text || CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END) AS hash FROM documents WHERE doc_id % 13 <> 5)
SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL OR o.hash <> n.hash THEN 'changed' ELSE 'deleted' END AS state FROM o FULL JOIN n ON o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR o.hash <> n.hash
""")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that an earlier and a later state differ in: the states are made here, by dropping and changing some."""
    docs = table(spark, sf_dir, "documents")
    old = docs.where("doc_id % 11 <> 3").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("was"))
    text = F.concat("text", F.when(F.col("doc_id") % 7 == 0, "!").otherwise(""))
    new = docs.where("doc_id % 13 <> 5").select(F.col("doc_id").alias("path"), F.sha2(text, 256).alias("hash"))
    both = old.join(new, "path", "full_outer").where(~F.col("was").eqNullSafe(F.col("hash")))
    return both.select("path", F.when(F.col("hash").isNull(), "deleted").otherwise("changed").alias("state"))


@query(f"""
WITH RECURSIVE {_F}, g AS (SELECT scan, path, cwe, id, line, engine, row_number() OVER (PARTITION BY scan, path, cwe ORDER BY rank DESC, id) AS k FROM f),
r(scan, path, cwe, k, kept) AS (SELECT DISTINCT scan, path, cwe, 0::BIGINT, []::STRUCT(id BIGINT, line BIGINT, engine VARCHAR, told VARCHAR[])[] FROM g
UNION ALL SELECT scan, path, cwe, k, CASE WHEN home IS NULL THEN list_append(kept, struct_pack(id := id, line := line, engine := engine, told := []::VARCHAR[]))
  ELSE list_transform(kept, lambda x, i: CASE WHEN i = home THEN struct_pack(id := x.id, line := x.line, engine := x.engine, told := list_append(x.told, engine)) ELSE x END) END
  FROM (SELECT r.scan, r.path, r.cwe, g.k, r.kept, g.id, g.line, g.engine, list_position(list_transform(r.kept, lambda x: x.engine <> g.engine AND abs(x.line - g.line) <= 2), true) AS home
    FROM r JOIN g ON g.scan = r.scan AND g.path = r.path AND g.cwe = r.cwe AND g.k = r.k + 1)),
e AS (SELECT unnest(max_by(kept, k)) AS x FROM r GROUP BY scan, path, cwe)
SELECT x.id AS id, array_to_string(list_sort(list_distinct(list_append(x.told, x.engine))), ',') AS engines, len(x.told)::BIGINT AS folded,
  ['low', 'medium', 'high'][least(3, x.id % 3 + 1 + CASE WHEN len(x.told) > 0 THEN 1 ELSE 0 END)] AS confidence FROM e
""")
def correlated_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of several engines for one weakness in a scan, folded on the best one: two lines apart at most.  Where engines agree, confidence rises a step."""
    rows = scan_findings(spark, sf_dir).withColumn("path", F.concat_ws(":", F.col("scan").cast("string"), "path"))
    own = F.element_at(F.array(*map(F.lit, codes.CONFIDENCES)), (F.col("id") % 3 + 1).cast("int"))
    found = triage.correlated(rows)
    return found.withColumn("confidence", F.when(F.col("folded") > 0, codes.bumped(own)).otherwise(own))
