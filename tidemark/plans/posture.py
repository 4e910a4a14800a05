"""Regions and disclosure, ignore rules, policies and versions over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import advisories, graph, regions, rules
from tidemark.plans.catalogue import query
from tidemark.sources.tables import table, values

# --- regions -----------------------------------------------------------------------------------------------

_REGIONS = """
seg AS (SELECT l_orderkey AS slice, 'src/p' || (l_partkey // 40) || '.py' AS path, (l_orderkey * 7 + l_linenumber * 13) % 3000 + 1 AS start, (l_orderkey * 7 + l_linenumber * 13) % 3000 + l_quantity::INT AS "end",
  (l_quantity * 10)::BIGINT AS tokens, o_orderpriority AS strategy, l_returnflag AS provider, l_linestatus AS scan FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
fn AS (SELECT 'src/p' || (p_partkey // 40) || '.py' AS path, p_name || p_partkey AS name, p_partkey * 13 % 3000 + 1 AS start, p_partkey * 13 % 3000 + 1 + p_size * 2 AS "end" FROM part),
fl AS (SELECT path, max("end") + 100 AS lines FROM fn GROUP BY path)
"""


def _path(key: str) -> F.Column:
    return F.concat(F.lit("src/p"), F.floor(F.col(key) / 40).cast("string"), F.lit(".py"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment a line of an order; an order is a slice."""
    place = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 3000
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("strategy"))
    return table(spark, sf_dir, "lineitem").join(orders, "l_orderkey").select(
        F.col("l_orderkey").alias("slice"), _path("l_partkey").alias("path"), (place + 1).alias("start"), (place + F.round("l_quantity").cast("int")).alias("end"),
        F.round(F.col("l_quantity") * 10).cast("long").alias("tokens"), "strategy", F.col("l_returnflag").alias("provider"), F.col("l_linestatus").alias("scan"),
    )


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function a part."""
    start = F.col("p_partkey") * 13 % 3000 + 1
    return table(spark, sf_dir, "part").select(
        _path("p_partkey").alias("path"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"), start.alias("start"), (start + F.col("p_size") * 2).alias("end")
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return functions(spark, sf_dir).groupBy("path").agg((F.max("end") + 100).alias("lines"))


@query(f"""
WITH {_REGIONS}, f AS (SELECT ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS id, 'src/p' || (l_partkey // 40) || '.py' AS path, (l_orderkey * 7 + l_linenumber * 13) % 3000 + 1 AS line FROM lineitem),
m AS (SELECT f.id, fn.name AS range, fn.start, fn."end", row_number() OVER (PARTITION BY f.id ORDER BY fn."end" - fn.start, fn.start DESC, fn.name) AS k
  FROM f JOIN fn ON fn.path = f.path AND f.line BETWEEN fn.start AND fn."end")
SELECT id, range, start, "end" FROM m WHERE k = 1
""")
def innermost_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The innermost function around the place of each line."""
    place = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 3000 + 1
    ident = ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")
    positions = table(spark, sf_dir, "lineitem").select(ident.alias("id"), _path("l_partkey").alias("path"), place.alias("line"))
    return regions.innermost(positions, functions(spark, sf_dir).withColumnRenamed("name", "range"))


@query(f"""
WITH {_REGIONS}, l AS (SELECT slice, sum("end" - start + 1)::BIGINT AS lines, sum(tokens)::BIGINT AS tokens FROM seg GROUP BY slice),
w AS (SELECT slice, count(*) AS files, sum(lines) AS file_lines FROM (SELECT DISTINCT slice, path FROM seg) JOIN fl USING (path) GROUP BY slice),
t AS (SELECT slice, count(DISTINCT (fn.path, fn.name)) AS functions FROM seg JOIN fn ON fn.path = seg.path AND seg.start <= fn."end" AND fn.start <= seg."end" GROUP BY slice)
SELECT slice, l.lines, l.tokens, coalesce(functions, 0) AS functions, coalesce(files, 0) AS files, coalesce(round(l.lines / file_lines, 9), 0) AS file_fraction,
  round(l.lines / (SELECT sum(lines) FROM fl), 9) AS repo_fraction FROM l LEFT JOIN w USING (slice) LEFT JOIN t USING (slice)
""")
def slice_disclosures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each order shows of the repository."""
    return regions.slice_disclosure(segments(spark, sf_dir), functions(spark, sf_dir), files(spark, sf_dir))


@query(f"""
WITH {_REGIONS}, t AS (SELECT DISTINCT slice, fn.path || chr(31) || fn.name AS k FROM seg JOIN fn ON fn.path = seg.path AND seg.start <= fn."end" AND fn.start <= seg."end"),
u AS (SELECT count(*) AS n FROM (SELECT DISTINCT path, unnest(range(start, "end" + 1)) AS line FROM seg)),
r AS (SELECT 'slices' AS name, count(DISTINCT slice)::DOUBLE AS value FROM seg UNION ALL SELECT 'files', count(DISTINCT path) FROM seg UNION ALL SELECT 'lines_prepared_total', sum("end" - start + 1) FROM seg
UNION ALL SELECT 'tokens_estimated', sum(tokens) FROM seg UNION ALL SELECT 'functions', count(DISTINCT k) FROM t UNION ALL SELECT 'call_edges', count(*) FROM (SELECT DISTINCT a.k, b.k FROM t a JOIN t b ON a.slice = b.slice AND a.k < b.k)
UNION ALL SELECT 'lines_disclosed', n FROM u UNION ALL SELECT 'repository_fraction_pct', round(100 * n / (SELECT sum(lines) FROM fl), 6) FROM u UNION ALL SELECT 'strategy_' || strategy, count(DISTINCT slice) FROM seg GROUP BY strategy)
SELECT * FROM r
""")
def scan_disclosures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all orders together show."""
    return regions.scan_disclosure(segments(spark, sf_dir), functions(spark, sf_dir), files(spark, sf_dir))


_KEY = b"an account's own key"
_LINES = 150_000
_FILE = (
    "substr(sha256('{o}'::BLOB || unhex(sha256('{i}'::BLOB || encode(path)))), 1, 24)".format(
        **{n: "".join(f"\\x{b ^ pad:02X}" for b in _KEY.ljust(64, b"\0")) for n, pad in (("i", 0x36), ("o", 0x5C))}
    )
)


@query(f"""
WITH {_REGIONS}, a AS (SELECT DISTINCT provider, scan, {_FILE} AS file, unnest(range(start, "end" + 1)) AS line FROM seg)
SELECT provider, scan, count(DISTINCT file) AS files, count(*) AS lines, round(100 * count(*) / {_LINES}, 6) AS pct FROM a GROUP BY ALL
UNION ALL SELECT provider, NULL, count(DISTINCT file), count(*), round(100 * count(*) / {_LINES}, 6) FROM (SELECT DISTINCT provider, file, line FROM a) GROUP BY provider
""")
def provider_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lines that each provider saw, by scan and over all."""
    return regions.exposure(regions.exposure_account(segments(spark, sf_dir), _KEY), _LINES)


_WHAT_IF = "cand AS (SELECT slice, CASE slice % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS provider, path, start + 5 AS start, \"end\" + 9 AS \"end\" FROM seg)"


@query(f"""
WITH {_REGIONS}, {_WHAT_IF}, a AS (SELECT DISTINCT provider, path, unnest(range(start, "end" + 1)) AS line FROM seg),
s AS (SELECT provider, count(*) AS seen FROM a GROUP BY provider), c AS (SELECT slice, provider, path, unnest(range(start, "end" + 1)) AS line FROM cand),
x AS (SELECT c.slice, c.provider, sum((a.line IS NULL)::INT)::BIGINT AS extra FROM c LEFT JOIN a USING (provider, path, line) GROUP BY ALL)
SELECT slice, provider, extra, round(100 * (seen + extra) / {_LINES}, 6) AS pct FROM x JOIN s USING (provider)
""")
def exposure_what_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each order, were it sent to one of the providers as well, would add to what that one has seen."""
    rows = segments(spark, sf_dir)
    provider = F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("slice") % 3 + 1).cast("int"))
    candidates = rows.select("slice", provider.alias("provider"), "path", (F.col("start") + 5).alias("start"), (F.col("end") + 9).alias("end"))
    return regions.would_reach(regions.exposure_account(rows, _KEY), candidates, _KEY, _LINES)


# --- versions ----------------------------------------------------------------------------------------------

_VERSIONS = """
f AS (SELECT p_partkey AS id, p_brand AS brand, p_partkey % 200 AS lib, p_size % 2 AS e, p_partkey % 4 AS a, p_size % 12 AS b, p_partkey % 3 AS c, (p_partkey * 5 + p_size) % 7 AS k, p_size % 11 AS n FROM part),
v AS (SELECT id, brand, lib, 'PyPI' AS ecosystem, CASE WHEN e = 1 THEN '1!' ELSE '' END || a || '.' || b || CASE WHEN c = 0 AND id % 2 = 0 THEN '' ELSE '.' || c END
    || ['', 'a' || n, '-beta.' || n, 'rc' || n, '.post' || n, '.dev' || n, 'C' || n || '.dev3+local.1'][k + 1] AS version,
  [e, a, b, c, [9, 1, 2, 3, 9, 0, 3][k + 1], CASE WHEN k IN (1, 2, 3, 6) THEN n ELSE 0 END, CASE WHEN k = 4 THEN n ELSE -1 END, CASE WHEN k = 5 THEN n WHEN k = 6 THEN 3 ELSE 99 END] AS key FROM f
UNION ALL SELECT id, brand, lib, 'npm', 'v' || a || '.' || b || '.' || c || ['', '-alpha', '-alpha.' || n, '-beta.' || n, '-' || n, '+build' || n, '-rc.' || n || '.x'][k + 1],
  [a, b, c] || CASE k WHEN 0 THEN [1] WHEN 5 THEN [1] WHEN 1 THEN [0, 1, 0] WHEN 2 THEN [0, 1, 0, 0, n] WHEN 3 THEN [0, 1, 1, 0, n] WHEN 4 THEN [0, 0, n] ELSE [0, 1, 2, 0, n, 1] END FROM f
UNION ALL SELECT id, brand, lib, 'Maven', a || '.' || b || '.' || c || ['', '-SNAPSHOT', '-alpha-' || n, '.BETA' || n, '-rc' || n, '-SP-' || n, '.Final'][k + 1],
  [a, b, c, [5, 4, 0, 1, 3, 6, 5][k + 1], CASE WHEN k IN (2, 3, 4, 5) THEN n ELSE 0 END] FROM f
UNION ALL SELECT id, brand, lib, 'Go', 'v' || a || '.' || b || '.' || c || CASE WHEN k < 3 THEN '-0.202' || k || '0101' || (100000 + n) || '-0123456789ab' WHEN k = 3 THEN '-pre' ELSE '' END,
  [a, b, c, CASE WHEN k = 3 THEN 0 ELSE 1 END] || CASE WHEN k < 3 THEN [k, n] ELSE []::BIGINT[] END FROM f)
"""


def part_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, brand, lib, ecosystem, version): a version a part in each of four ecosystems."""
    col = lambda e: F.expr(e)
    f = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), col("p_partkey % 200 AS lib"), col("p_size % 2 AS e"), col("p_partkey % 4 AS a"), col("p_size % 12 AS b"),
        col("p_partkey % 3 AS c"), col("cast((p_partkey * 5 + p_size) % 7 AS int) AS k"), col("p_size % 11 AS n"),
    )
    texts = {
        "PyPI": "concat(if(e = 1, '1!', ''), a, '.', b, if(c = 0 AND id % 2 = 0, '', concat('.', c)), array('', concat('a', n), concat('-beta.', n), concat('rc', n), concat('.post', n), concat('.dev', n), concat('C', n, '.dev3+local.1'))[k])",
        "npm": "concat('v', a, '.', b, '.', c, array('', '-alpha', concat('-alpha.', n), concat('-beta.', n), concat('-', n), concat('+build', n), concat('-rc.', n, '.x'))[k])",
        "Maven": "concat(a, '.', b, '.', c, array('', '-SNAPSHOT', concat('-alpha-', n), concat('.BETA', n), concat('-rc', n), concat('-SP-', n), '.Final')[k])",
        "Go": "concat('v', a, '.', b, '.', c, CASE WHEN k < 3 THEN concat('-0.202', k, '0101', 100000 + n, '-0123456789ab') WHEN k = 3 THEN '-pre' ELSE '' END)",
    }
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("ecosystem"), F.expr(text).alias("version")) for name, text in texts.items()))).alias("v")
    return f.select("id", "brand", "lib", each).select("id", "brand", "lib", "v.*")


@query(f"""
WITH {_VERSIONS}, w AS (SELECT *, lag(key) OVER o AS before, lag(version) OVER o AS previous FROM v WINDOW o AS (PARTITION BY ecosystem, brand, lib % 10 ORDER BY id))
SELECT id, ecosystem, previous, version, CASE WHEN before < key THEN -1 WHEN before > key THEN 1 ELSE 0 END AS cmp FROM w WHERE previous IS NOT NULL
""")
def version_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's version beside the one before it, in four orders."""
    order = Window.partitionBy("ecosystem", "brand", F.col("lib") % 10).orderBy("id")
    rows = advisories.keyed(part_versions(spark, sf_dir), key="version").withColumns({"previous": F.lag("version").over(order), "before": F.lag("key").over(order)})
    cmp = (F.col("before") > F.col("key")).cast("int") - (F.col("before") < F.col("key")).cast("int")
    return rows.where("previous IS NOT NULL").select("id", "ecosystem", "previous", "version", cmp.alias("cmp"))


@query(f"""
WITH {_VERSIONS}, r AS (SELECT 'ADV-' || id AS advisory, ecosystem, lib, key AS low, lead(key, 3) OVER (PARTITION BY ecosystem, lib ORDER BY id) AS high FROM v)
SELECT DISTINCT v.ecosystem, 'lib' || v.lib AS name, v.version, r.advisory FROM v JOIN r ON r.ecosystem = v.ecosystem AND r.lib = v.lib AND (r.advisory LIKE '%0' OR v.key >= r.low) AND (r.high IS NULL OR v.key < r.high)
""")
def affected_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions inside the ranges of advisories of their library; some ranges have no beginning or no end."""
    rows = part_versions(spark, sf_dir).withColumn("name", F.concat(F.lit("lib"), F.col("lib").cast("string")))
    later = F.lead("version", 3).over(Window.partitionBy("ecosystem", "lib").orderBy("id"))
    low = F.when(F.col("id") % 10 != 0, F.col("version"))
    ranges = rows.select(F.concat(F.lit("ADV-"), F.col("id").cast("string")).alias("advisory"), "ecosystem", "name", low.alias("introduced"), later.alias("fixed"))
    return advisories.affected(rows, ranges)


# --- rules on paths ----------------------------------------------------------------------------------------

#: Ignore lines: scope, line, and for the SQL the same as a regular expression (null: no rule).
_IGNORES = [
    ("", "# comment", None, False, False), ("", "*.html", r"^(?:.*/)?[^/]*\.html$", False, False), ("", "!*5.html", r"^(?:.*/)?[^/]*5\.html$", True, False),
    ("", "www.*/", r"^(?:.*/)?www\.[^/]*$", False, True), ("", "!www.*.net/", r"^(?:.*/)?www\.[^/]*\.net$", True, True), ("", "/m.*.com/fr", r"^m\.[^/]*\.com/fr$", False, False),
    ("", "**/es/?00", r"^(?:.*/)?es/[^/]00$", False, False), ("", "blog.*/**", r"^blog\.[^/]*/.*$", False, False), ("", "!blog.*/en", r"^blog\.[^/]*/en$", True, False),
    ("", "[1-3]1[0-9]", "^(?:.*/)?[1-3]1[0-9]$", False, False), ("", "   ", None, False, False), ("", "de/", "^(?:.*/)?de$", False, True), ("", "!de", "^(?:.*/)?de$", True, False),
    ("", "*.org/en/9*", r"^[^/]*\.org/en/9[^/]*$", False, False), ("", "77?", "^(?:.*/)?77[^/]$", False, False), ("", "!777", "^(?:.*/)?777$", True, False),
    ("", "a+b(c).$d", r"^(?:.*/)?a\+b\(c\)\.\$d$", False, False), ("en", "*", "^(?:.*/)?[^/]*$", False, False), ("", "fr/*2", "^fr/[^/]*2$", False, False), ("", "**/fr/**/3*", "^(?:.*/)?fr/(?:.*/)?3[^/]*$", False, False),
]


def _sql(v: object) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


@query(f"""
WITH p AS (SELECT DISTINCT rtrim(regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g'), '/') AS path FROM pages),
r AS (SELECT * FROM (VALUES {", ".join(f"({i}, {_sql(s)}, {_sql(x)}, {_sql(n)}, {_sql(d)})" for i, (s, _, x, n, d) in enumerate(_IGNORES) if x)}) AS t(no, scope, regex, negated, dir_only)),
b AS (SELECT path, unnest(range(1, len(string_split(path, '/')) + 1)) AS depth FROM p), e AS (SELECT path, depth, array_to_string(string_split(path, '/')[1:depth], '/') AS entry FROM b),
m AS (SELECT path, depth, max_by(negated, no) AS negated, max(no) AS no FROM e JOIN r ON (NOT dir_only OR entry <> path) AND scope = '' AND regexp_matches(entry, regex) GROUP BY ALL),
h AS (SELECT path, min_by(no, depth) AS rule_no FROM m WHERE NOT negated GROUP BY path)
SELECT path, rule_no IS NOT NULL AS ignored, rule_no FROM p LEFT JOIN h USING (path)
""")
def ignored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' paths under twenty ignore lines in order."""
    path = F.rtrim(F.regexp_replace("url", "^[a-z]+://|[?#].*$", ""), F.lit("/")).alias("path")
    lines = values(spark, [(i, s, line) for i, (s, line, *_) in enumerate(_IGNORES)], "rule_no int, scope string, line string")
    return rules.ignored_paths(table(spark, sf_dir, "pages").select(path), rules.parsed_ignores(lines))


_POLICY = {
    "p": [(0, "src1/**", 1, False), (1, "**", 0, False), (2, "src1/en/*", 0, False), (3, "*/de/7?.txt", 3, False), (4, "src2/fr/1.txt", None, True)],
    "q": [(0, "**/en/*", 1, False), (1, "src3/**", 2, False), (2, "src3/**/5*.txt", 0, True)],
    "c": [(0, "legal", "**/9*.txt", 2, False), (1, "legal", "src0/**", 2, False), (2, "secret", "**/99.txt", None, True), (3, "draft", "src[4-6]/es/*", 1, False)],
    "l": [(0, "FR", 2), (1, "es", 1), (2, "unknown", 3)],
    "w": [(0, "sql.*", 3), (1, "*", 0), (2, "xss.?", 2)],
}
_POLICY_SQL = ", ".join(f"{n}({cols}) AS (VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in _POLICY[n])})" for n, cols in
                        (("p", "no, pat, lev, never"), ("q", "no, pat, lev, never"), ("c", "no, tag, pat, lev, never"), ("l", "no, lang, lev"), ("w", "no, pat, lev")))
_TO_REGEX = "'^' || replace(replace(replace(replace(replace(replace(pat, '.', '\\.'), '**/', '<'), '**', '>'), '*', '[^/]*'), '?', '[^/]'), '<', '(?:.*/)?')"


@query(f"""
WITH {_POLICY_SQL}, d AS (SELECT doc_id, source || '/' || lang || '/' || (doc_id % 100) || '.txt' AS path, ['local', 'private', 'public', NULL][doc_id % 4 + 1] AS tier, lang,
  ['sql.injection', 'XSS.a', 'other', NULL][n_chars % 4 + 1] AS rule FROM documents),
x AS (SELECT 'p' AS t, no, '' AS tag, pat, lev, never FROM p UNION ALL SELECT 'q', no, '', pat, lev, never FROM q UNION ALL SELECT 'c', no, tag, pat, lev, never FROM c),
g AS (SELECT *, replace({_TO_REGEX}, '>', '.*') || '$' AS re, len(list_filter(string_split(pat, '/'), lambda s: NOT regexp_matches(s, '[*?\\[]'))) AS lit, len(string_split(pat, '/')) AS seg FROM x),
m AS (SELECT d.doc_id, g.* FROM d JOIN g ON regexp_matches(d.path, g.re)),
s AS (SELECT doc_id, 0 AS a, 0::BIGINT AS no, 'base' AS axis, '' AS name, 1 AS lev FROM d
UNION ALL SELECT doc_id, 1, 0, 'provider_tier', tier, CASE tier WHEN 'local' THEN 0 WHEN 'private' THEN 1 ELSE 2 END FROM d WHERE tier IS NOT NULL
UNION ALL SELECT DISTINCT doc_id, 2, 0, 'never_send', 'settings', NULL FROM m WHERE t = 'p' AND never
UNION ALL SELECT doc_id, 2, no + 1, 'never_send', 'path_rule' || no, NULL FROM m WHERE t = 'q' AND never
UNION ALL SELECT doc_id, 2, 1000000 + no, 'never_send', 'class_' || tag, NULL FROM m WHERE t = 'c' AND never
UNION ALL SELECT doc_id, 3, 0, 'settings_path', 'paths', max_by(lev, [lit, seg, no]) FROM m WHERE t = 'p' AND lev IS NOT NULL GROUP BY doc_id
UNION ALL SELECT doc_id, 4, no, 'path_rule', no::VARCHAR, lev FROM m WHERE t = 'q' AND NOT never
UNION ALL SELECT doc_id, 5, no, 'classification', tag, lev FROM m WHERE t = 'c' AND lev IS NOT NULL
UNION ALL SELECT doc_id, 6, no, 'language', lower(l.lang), lev FROM d JOIN l ON lower(l.lang) = d.lang
UNION ALL SELECT doc_id, 7, no, 'rule', pat, lev FROM d JOIN w ON regexp_matches(lower(rule), '^' || replace(replace(replace(pat, '.', '\\.'), '*', '[^/]*'), '?', '[^/]') || '$')),
t AS (SELECT doc_id, array_to_string(list(tag ORDER BY no), ',') AS tags FROM (SELECT doc_id, tag, min(no) AS no FROM m WHERE t = 'c' GROUP BY ALL) GROUP BY doc_id)
SELECT doc_id, max(lev)::INT AS level, bool_or(axis = 'never_send') AS never_send, coalesce(any_value(tags), '') AS tags, string_agg(axis || ':' || name || ':' || coalesce(lev::VARCHAR, '-'), ';' ORDER BY a, no) AS said
FROM s LEFT JOIN t USING (doc_id) GROUP BY doc_id
""")
def policy_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's level by path, tier, class, language and rule, with what every axis said."""
    pick = lambda options, by: F.element_at(F.array(*map(F.lit, options)), (F.col(by) % len(options) + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat_ws("/", "source", "lang", F.concat((F.col("doc_id") % 100).cast("string"), F.lit(".txt"))).alias("path"),
        pick(("local", "private", "public", None), "doc_id").alias("tier"), F.col("lang").alias("language"), pick(("sql.injection", "XSS.a", "other", None), "n_chars").alias("rule"),
    )
    shapes = {"p": "no int, pattern string, level int, never_send boolean", "c": "no int, tag string, pattern string, level int, never_send boolean", "l": "no int, language string, level int", "w": "no int, pattern string, level int"}
    made = {n: values(spark, r, shapes["p" if n == "q" else n]) for n, r in _POLICY.items()}
    found = rules.resolved(docs, rules.Policy(1, {"local": 0, "private": 1, "public": 2}, made["p"], made["q"], made["c"], made["l"], made["w"]))
    said = F.transform("contributions", lambda s: F.concat(s["axis"], F.lit(":"), s["name"], F.lit(":"), F.coalesce(s["level"].cast("string"), F.lit("-"))))
    return found.select("doc_id", "level", "never_send", F.array_join("tags", ",").alias("tags"), F.array_join(said, ";").alias("said"))


# --- dependencies ------------------------------------------------------------------------------------------

_PACKAGES = """
x AS (SELECT 'app' || (l_suppkey % 20) AS folder, ['PyPI', 'npm', 'Go'][l_partkey % 3 + 1] AS ecosystem, 'Lib_' || (l_partkey % 300) AS name, '1.' || l_linenumber || '.' || (l_suppkey % 3) AS version,
  ['lib-' || ((l_partkey + l_suppkey * 3) % 300), 'none'] AS requires, l_linenumber = 1 OR l_suppkey % 20 >= 15 AS declared, '>=' || (l_orderkey % 4) AS declared_range, l_returnflag AS scope, 'm' || (l_orderkey % 3) AS manifest FROM lineitem),
k AS (SELECT DISTINCT folder, ecosystem, name, version, requires, folder || '/lock-' || lower(ecosystem) AS path, 'pkg:' || lower(ecosystem) || '/' || replace(lower(name), '_', '-') || '@' || version AS purl FROM x WHERE NOT declared),
l AS (SELECT folder, ecosystem, name, version, path, purl, min(requires) AS requires FROM k GROUP BY ALL),
c AS (SELECT DISTINCT folder, ecosystem FROM l), dec AS (SELECT DISTINCT folder, ecosystem, name, folder || '/' || manifest AS path, declared_range, scope FROM x WHERE declared),
s AS (SELECT folder, ecosystem, name, max((path, declared_range, scope)) AS said FROM dec JOIN c USING (folder, ecosystem) GROUP BY ALL),
r AS (SELECT folder, path, ecosystem, name, version, purl, said IS NOT NULL AS direct, said[3] AS scope, said[2] AS declared_range, requires FROM l LEFT JOIN s USING (folder, ecosystem, name)
UNION ALL SELECT folder, path, ecosystem, name, NULL, 'pkg:' || lower(ecosystem) || '/' || replace(lower(name), '_', '-'), true, min(scope), declared_range, [] FROM dec ANTI JOIN c USING (folder, ecosystem) GROUP BY ALL)
"""


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of lock files and manifests of twenty folders, the last five of which have no lock files, from the lines of orders."""
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    part, supplier, order, line = (F.col(f"l_{c}") for c in ("partkey", "suppkey", "orderkey", "linenumber"))
    x = table(spark, sf_dir, "lineitem").select(
        text("app", supplier % 20).alias("folder"), F.element_at(F.array(F.lit("PyPI"), F.lit("npm"), F.lit("Go")), (part % 3 + 1).cast("int")).alias("ecosystem"), text("Lib_", part % 300).alias("name"),
        text("1.", line, ".", supplier % 3).alias("version"), F.array(text("lib-", (part + supplier * 3) % 300), F.lit("none")).alias("requires"), ((line == 1) | (supplier % 20 >= 15)).alias("declared"),
        text(">=", order % 4).alias("declared_range"), F.col("l_returnflag").alias("scope"), text("m", order % 3).alias("manifest"),
    )
    path = F.concat("folder", F.lit("/lock-"), F.lower("ecosystem"))
    locks = x.where("NOT declared").groupBy("folder", path.alias("path"), "ecosystem", "name", "version").agg(F.min("requires").alias("requires"))
    manifest = F.concat("folder", F.lit("/"), "manifest").alias("path")
    manifests = x.where("declared").groupBy("folder", manifest, "ecosystem", "name", "declared_range").agg(F.collect_set("scope").alias("scopes"))
    known = locks.select("folder", "ecosystem").distinct().withColumn("locked", F.lit(True))
    # Of a folder without a lock the least scope of a range counts; where there is one all are told.
    each = F.explode(F.when(F.col("locked"), F.col("scopes")).otherwise(F.array(F.array_min("scopes")))).alias("scope")
    return advisories.dependency_rows(manifests.join(known, ["folder", "ecosystem"], "left").select("folder", "path", "ecosystem", "name", "declared_range", each), locks)


@query(f"WITH {_PACKAGES} SELECT folder, path, ecosystem, name, version, purl, direct, scope, declared_range, array_to_string(requires, ',') AS requires FROM r")
def dependency_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory of all folders: lock files win, manifests mark what is direct."""
    return packages(spark, sf_dir).withColumn("requires", F.array_join("requires", ","))


@query(f"""
WITH RECURSIVE {_PACKAGES}, f AS (SELECT ecosystem, replace(lower(name), '_', '-') AS need, min_by(purl, (name, coalesce(version, ''), path)) AS b FROM r GROUP BY ALL),
e AS (SELECT DISTINCT a, b FROM (SELECT ecosystem, purl AS a, unnest(requires) AS need FROM r) JOIN f USING (ecosystem, need)),
d(node, depth) AS (SELECT DISTINCT purl, 0 FROM r WHERE direct UNION SELECT b, depth + 1 FROM d JOIN e ON a = node WHERE depth < 25)
SELECT node AS purl, min(depth)::INT AS depth FROM d GROUP BY node
""")
def dependency_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each component is from what is declared, along what the components require."""
    rows = graph.stored(packages(spark, sf_dir))
    found = graph.depths(advisories.dependency_edges(rows), rows.where("direct").select(F.col("purl").alias("node")))
    return found.withColumnRenamed("node", "purl")
