"""Further queries of the catalogue: co-occurrence, matching, exposure, ranges, scalars and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.functions import text as T
from tidemark.operators import detection, matching, temporal
from tidemark.plans.catalogue import query
from tidemark.sources.tables import table
from tidemark.streaming import windows

# --- joins -------------------------------------------------------------------------------------------------


@query("""
WITH e AS (SELECT DISTINCT user_id, event_type FROM events)
SELECT a.event_type AS left_type, b.event_type AS right_type, count(*) AS users
FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY 1, 2
""")
def co_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that the same user shows.  A user's types are gathered (five at most) and paired inside the row."""
    sets = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("t"))
    pairs = sets.select(
        F.explode(
            F.flatten(
                F.transform("t", lambda a, i: F.transform(F.slice("t", i + 2, F.size("t")), lambda b: F.struct(a.alias("l"), b.alias("r"))))
            )
        ).alias("p")
    )
    return pairs.groupBy(F.col("p.l").alias("left_type"), F.col("p.r").alias("right_type")).agg(F.count("*").alias("users"))


@query("""
WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant')
SELECT u.conv_id, u.turn AS request_turn, a.turn AS response_turn, length(u.text) AS request_chars, length(a.text) AS response_chars
FROM u LEFT JOIN a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
""")
def request_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.char_length("text").cast("long").alias("chars"))
    asked = turns.where("role = 'user'").select("conv_id", F.col("turn").alias("request_turn"), F.col("chars").alias("request_chars"))
    told = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("request_turn"), F.col("turn").alias("response_turn"), F.col("chars").alias("response_chars")
    )
    return asked.join(told, ["conv_id", "request_turn"], "left")


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def orphan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    english = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    return table(spark, sf_dir, "labels").select("doc_id").join(english, "doc_id", "left_anti")


@query("""
WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '555-[0-9]{4}')) AS token FROM documents),
g AS (SELECT token, min(doc_id) AS first_doc, count(*) AS holders FROM t GROUP BY token HAVING count(*) > 1)
SELECT doc_id, token, first_doc, holders FROM t JOIN g USING (token)
""")
def linkability_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a number: each with the first that holds it and how many do, which stands for all pairs among them."""
    found = T.matches(F.col("text"), T.LOCAL_NUMBER)
    tokens = table(spark, sf_dir, "documents").where(F.col("text").rlike(T.LOCAL_NUMBER)).select("doc_id", F.explode(F.array_distinct(found)).alias("token")).distinct()
    held = tokens.groupBy("token").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("holders")).where("holders > 1")
    return tokens.join(held, "token").select("doc_id", "token", "first_doc", "holders")


@query("""
WITH c AS (SELECT event_id, user_id, epoch(date_trunc('second', ts))::BIGINT AS t FROM events WHERE event_type = 'click'),
p AS (SELECT event_id, user_id, epoch(date_trunc('second', ts))::BIGINT AS t FROM events WHERE event_type = 'purchase'),
m AS (SELECT p.event_id AS purchase, c.event_id AS click, row_number() OVER (PARTITION BY p.event_id ORDER BY p.t - c.t, c.event_id) AS r
  FROM p JOIN c ON p.user_id = c.user_id AND c.t <= p.t AND p.t - c.t <= 86400)
SELECT purchase, click FROM m WHERE r = 1
""")
def interval_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest click in the day before each purchase."""
    rows = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t")
    )
    return matching.nearest_before(
        rows.where("event_type = 'purchase'"), rows.where("event_type = 'click'"), "user_id", "t", "event_id", 86400
    ).select(F.col("left_id").alias("purchase"), F.col("right_id").alias("click"))


@query("""
WITH RECURSIVE e AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS t FROM events), p AS (SELECT user_id, t, min(event_id) AS id FROM e GROUP BY user_id, t),
j AS (SELECT p.user_id, p.t, p.id, n.t AS nt, n.id AS nid FROM p ASOF LEFT JOIN p n ON p.user_id = n.user_id AND p.t + 600 < n.t),
s(user_id, t, id, nt, nid) AS (SELECT user_id, t, id, nt, nid FROM j QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t) = 1 UNION ALL SELECT j.user_id, j.t, j.id, j.nt, j.nid FROM s JOIN j ON s.user_id = j.user_id AND s.nt = j.t)
SELECT e.event_id AS id, s.id AS group_id FROM e ASOF JOIN s ON e.user_id = s.user_id AND e.t >= s.t
""")
def correlate_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user folded greedily: one joins the open group if it comes within ten minutes of the group's first."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"))
    return matching.greedy_fold(rows, "user_id", "t", "event_id", 600)


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 95 % interval of the share of toxic labels: 200 resamples, each row weighted by a Poisson draw of its hash."""
    return matching.poisson_bootstrap(table(spark, sf_dir, "labels"), "doc_id", "toxic", 200)


# --- measures ----------------------------------------------------------------------------------------------


@query("""
WITH s(sector, cue) AS (VALUES ('health', 'the'), ('finance', 'der'), ('law', 'les'), ('public', 'los')),
h AS (SELECT d.doc_id, s.sector, (length(lower(text)) - length(replace(lower(text), cue, ''))) // length(cue) AS hits FROM documents d, s),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, sector) AS k FROM h WHERE hits > 0)
SELECT sector, count(*) AS docs, sum(hits)::BIGINT AS hits FROM r WHERE k = 1 GROUP BY sector
""")
def sector_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sector whose cue a document has most of: counted in the row, without a join."""
    low = F.lower("text")
    cues = [("finance", "der"), ("health", "the"), ("law", "les"), ("public", "los")]
    count = lambda cue: F.floor((F.length(low) - F.length(F.replace(low, F.lit(cue), F.lit("")))) / len(cue))
    hits = F.array(*(F.struct((-count(c)).alias("less"), F.lit(s).alias("sector")) for s, c in cues))
    best = table(spark, sf_dir, "documents").select("doc_id", F.array_min(hits).alias("b")).where("b.less < 0")
    return best.groupBy("b.sector").agg(F.count("*").alias("docs"), F.sum(-F.col("b.less")).alias("hits"))


@query("""
SELECT item_id, (SELECT count(*) FROM documents d WHERE contains(d.text, b.text)) AS exposed_in FROM benchmark b
""")
def canary_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item, found by an equi-join on words inside and checked."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("canary"))
    return matching.substring_counts(table(spark, sf_dir, "documents"), items)


@query("""
SELECT least(9, floor(l_quantity / 6))::INT AS likelihood_factor, least(9, floor(l_discount * 100))::INT AS impact_factor,
  CASE WHEN least(9, floor(l_quantity / 6)) < 3 THEN 'low' WHEN least(9, floor(l_quantity / 6)) < 6 THEN 'medium' ELSE 'high' END AS likelihood,
  CASE WHEN least(9, floor(l_discount * 100)) < 3 THEN 'low' WHEN least(9, floor(l_discount * 100)) < 6 THEN 'medium' ELSE 'high' END AS impact,
  count(*) AS n FROM lineitem GROUP BY 1, 2, 3, 4
""")
def owasp_band_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").select(
        F.least(F.lit(9), F.floor(F.col("l_quantity") / 6)).cast("int").alias("likelihood_factor"),
        F.least(F.lit(9), F.floor(F.col("l_discount") * 100)).cast("int").alias("impact_factor"),
    )
    counted = cells.groupBy("likelihood_factor", "impact_factor").agg(F.count("*").alias("n"))
    return counted.withColumns(
        {"likelihood": scalars.owasp_band(F.col("likelihood_factor")), "impact": scalars.owasp_band(F.col("impact_factor"))}
    )


@query("""
SELECT event_type, user_id, total FROM (SELECT event_type, user_id, round(sum(value), 4) AS total,
  row_number() OVER (PARTITION BY event_type ORDER BY round(sum(value), 4) DESC, user_id) AS r FROM events GROUP BY 1, 2) WHERE r <= 3
""")
def top_k_per_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.round(F.sum("value"), 4).alias("total"))
    place = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("total"), "user_id"))
    return sums.withColumn("r", place).where("r <= 3").drop("r")


@query("""
WITH f AS (SELECT user_id, min(event_id) AS first_seen FROM events GROUP BY user_id)
SELECT user_id, first_seen, row_number() OVER (ORDER BY first_seen) AS pseudonym FROM f
""")
def pseudonym_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users numbered in the order of their first event: a sort by ranges, and running counts of the ranges."""
    first = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("first_seen"))
    return detection.numbered(first, [], ["first_seen"], "pseudonym")


@query("""
SELECT user_id, min(ts) AS oldest, max(ts) AS newest, count(*) AS n, date_diff('day', min(ts)::DATE, max(ts)::DATE) AS days
FROM events GROUP BY user_id
""")
def retention_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.min("ts").alias("oldest"), F.max("ts").alias("newest"), F.count("*").alias("n")
    )
    return bounds.withColumn("days", F.date_diff(F.col("newest").cast("date"), F.col("oldest").cast("date")).cast("long"))


@query("""
WITH r AS (SELECT l_orderkey AS k, l_linenumber * 10 AS s, l_linenumber * 10 + l_quantity::INT AS e FROM lineitem),
m AS (SELECT *, CASE WHEN max(e) OVER w IS NULL OR s > max(e) OVER w THEN 1 ELSE 0 END AS o FROM r
  WINDOW w AS (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, sum(o) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT k, count(*) AS n_islands, sum(e - s)::BIGINT AS seconds FROM (SELECT k, g, min(s) AS s, max(e) AS e FROM i GROUP BY k, g) GROUP BY k
""")
def range_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"),
        (F.col("l_linenumber") * 10).alias("s"),
        (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int")).alias("e"),
    )
    return temporal.union_seconds(rows, "k", "s", "e")


# --- scalars -----------------------------------------------------------------------------------------------

@query("""
WITH c AS (SELECT doc_id, lang, length(text) AS n, length(regexp_replace(text, '[^\\x00-\\x7f]', '', 'g')) AS ascii FROM documents)
SELECT lang, count(*) AS docs, count(*) FILTER (WHERE ascii = n) AS all_ascii, round(avg(ascii / n), 6) AS ascii_share FROM c WHERE n > 0 GROUP BY lang
""")
def alphabet_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select(
        "lang", F.char_length("text").alias("n"), F.char_length(F.regexp_replace("text", r"[^\x00-\x7f]", "")).alias("ascii")
    )
    return sized.where("n > 0").groupBy("lang").agg(
        F.count("*").alias("docs"),
        F.count_if(F.col("ascii") == F.col("n")).alias("all_ascii"),
        F.round(F.avg(F.col("ascii") / F.col("n")), 6).alias("ascii_share"),
    )


@query("""
SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host,
  regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/+', '/', 'g'), '(.)/$', '\\1') AS path FROM pages
""")
def url_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select(
        "page_id",
        "url",
        F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)).alias("host"),
        F.regexp_replace(F.regexp_replace(path, "/+", "/"), "(.)/$", "$1").alias("path"),
    )


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity < 10 THEN '<10' WHEN l_quantity < 25 THEN '10-24' ELSE '25+' END AS quantity_band,
  round(l_extendedprice / 1000) * 1000 AS price_band FROM lineitem
""")
def number_generalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.when(q < 10, "<10").when(q < 25, "10-24").otherwise("25+").alias("quantity_band"),
        (F.round(F.col("l_extendedprice") / 1000) * 1000).alias("price_band"),
    )


# --- streams -----------------------------------------------------------------------------------------------


@query("""
SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2
""")
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.daily_counts(spark, sf_dir)
