"""N-gram Jaccard join with adaptive multi-match prefixes.

Tokens are shingle hashes.  Two sets of similarity t or more share so many tokens that the
prefixes of length n - ceil(t n) + l, under any order common to all sets, share l tokens.

1. Equal sets become one class, which its smallest id stands for.
2. Under the order of the hashes, a class whose prefix holds more than n - ceil(t n) tokens of no other
   class has no partner.  This takes counts only: tokens that many documents hold are summed
   before the shuffle.
3. The classes that are left link to the leaders of their prefix tokens and are verified.
4. For all pairs across the resulting components: tokens are ordered by the number of open sets
   that hold them, those of one component alone first.  Each class chooses l by estimated cost, reading its postings
   against verifying the candidates they may give: common tokens make a prefix longer, and a
   candidate must then share the smaller l of the two.  Pairs of sets that one set leads, as in a large
   group of near copies, are compared by their differences from it instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import linking
from tidemark.llm.frames import cut, fresh, may_match, slices, tidy
from tidemark.llm.linking import least_overlap, list_column
from tidemark.llm.textkit import fingerprint, shingle_sets

#: The contract's: four words, 85 of 100.
WORDS = 4
PERCENT = 85
#: Prefix tokens beyond the bound in the counting pass, as a part of the set.
SPARE = 0.02
#: The part of a prefix that must point to one leader before that pair is verified early.
LEADER_PART = 0.25
#: Cost of verifying a candidate, in postings read, and the most matches that a prefix asks for.
VERIFY_COST = 40
MOST_MATCHES = 8


def sketches(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n, fp1, fp2, prefix): the size, the name and the smallest hashes of each document's set."""
    schema = "id long, n int, fp1 long, fp2 long, prefix array<bigint>"

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, names, rows = [], [], []
            for tokens in shingle_sets(batch.column("text").cast(pa.binary()).to_pylist(), width):
                n = len(tokens)
                sizes.append(n)
                names.append(fingerprint(tokens))
                rows.append(tokens[: n - least_overlap(n, percent) + 1 + int(np.ceil(SPARE * n))])
            yield pa.record_batch(
                [
                    batch.column("id"),
                    pa.array(sizes, type=pa.int32()),
                    pa.array([a for a, _ in names], type=pa.int64()),
                    pa.array([b for _, b in names], type=pa.int64()),
                    list_column(rows),
                ],
                names=["id", "n", "fp1", "fp2", "prefix"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(sketch, schema)


def _slack(n, percent: int):
    """Tokens of a set of n that a partner may lack."""
    return F.floor(n * (100 - percent) / 100)


def _prefixes(ordered: DataFrame, percent: int) -> DataFrame:
    """(id, n, component, bucket, need) from (id, n, component, items).

    items are the (holders, token) that several components hold, ascending; the others come before them.
    """
    schema = "id long, n int, component long, need int, free int, buckets array<bigint>"

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            items = batch.column("items")
            lists = items.offsets.to_numpy()
            holders = items.values.field("holders").to_numpy(zero_copy_only=False)
            tokens = items.values.field("token").to_numpy(zero_copy_only=False)
            keep, needs, frees, rows = [], [], [], []
            for i, n in enumerate(batch.column("n").to_pylist()):
                c = holders[lists[i] : lists[i + 1]].astype(np.float64)
                t = tokens[lists[i] : lists[i + 1]]
                # The n - len(c) tokens that no other component holds come first in the order.
                spare = n - least_overlap(n, percent) - (n - len(c))
                if spare < 0:
                    continue
                most = min(MOST_MATCHES, len(c) - spare)
                reads = np.cumsum(c)[spare : spare + most]
                matches = np.arange(1, most + 1)
                need = int(np.argmin(reads + VERIFY_COST * reads / matches)) + 1
                keep.append(i)
                needs.append(need)
                frees.append(n - len(c))
                rows.append(t[: spare + need])
            kept = batch.select(["id", "n", "component"]).take(pa.array(keep, type=pa.int64()))
            yield pa.record_batch(
                [*kept.columns, pa.array(needs, type=pa.int32()), pa.array(frees, type=pa.int32()), list_column(rows)],
                names=["id", "n", "component", "need", "free", "buckets"],
            )

    found = ordered.mapInArrow(choose, schema)
    return found.select("id", "n", "component", "need", "free", F.explode("buckets").alias("bucket"))


def similar_classes(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(members, labels): (id, n, rep) of each row with an id, and the component of each rep that isn't its own.

    rep is the smallest id whose set equals the row's; rows without shingles have none.
    """
    rows = cut(sketches(docs.where(F.col("doc_id").isNotNull()), width, percent))
    classes = (
        rows.where("n > 0").groupBy("fp1", "fp2", "n").agg(F.min("id").alias("rep"), F.first("prefix").alias("prefix"))
    )
    reps = classes.select("fp1", "fp2", F.col("n").alias("m"), "rep")
    members = rows.select("id", "n", "fp1", "fp2").join(reps, ["fp1", "fp2"], "left").select("id", "n", "rep")

    postings = classes.select(F.col("rep").alias("id"), F.explode("prefix").alias("token"))
    alone = (
        postings.groupBy("token")
        .agg(F.count("*").alias("c"), F.min("id").alias("id"))
        .where("c = 1")
        .groupBy("id")
        .agg(F.count("*").alias("alone"))
    )
    survivors = (
        classes.select(F.col("rep").alias("id"), "n")
        .join(alone, "id", "left")
        .where(F.coalesce("alone", F.lit(0)) <= _slack(F.col("n"), percent))
        .select("id")
    )
    survivors = cut(survivors)
    wanted = may_match(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), "id", survivors)
    texts = cut(
        wanted.join(survivors, "id").groupBy("id", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text")).drop("h")
    )

    def make(texts: list[bytes | None]) -> list[np.ndarray]:
        return shingle_sets(texts, width)

    def slack(n: int) -> int:
        return n - least_overlap(n, percent)

    near = linking.sets_of(texts, make, lambda n: slack(n) + 1).select(
        "id", F.size("tokens").alias("n_buckets"), F.explode("tokens").alias("bucket")
    )
    leads = linking.to_leaders(near, LEADER_PART)
    labels = cut(linking.components(linking.verify(leads, texts, make, percent)))

    # Exhaustive across components, for the sets that may have a partner in another one: first by the smallest
    # hashes of all, then by the whole sets of those left.
    open_texts = linking.with_component(texts, labels)
    for part in (lambda n: slack(n) + 1 + -(-n // 20), None):
        sets = linking.sets_of(open_texts, make, part)
        placed = linking.with_component(sets, labels).select("id", "n", "component", F.explode("tokens").alias("token"))
        holders = cut(
            placed.groupBy("token")
            .agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").cast("int").alias("holders"))
            .where("lo < hi")
            .select("token", "holders")
        )
        length = F.size("tokens")
        spread = sets.select("id", "n", length.alias("seen"), F.explode("tokens").alias("token"))
        open_ids = cut(
            may_match(spread, "token", holders, "token")
            .groupBy("id")
            .agg(F.count("*").alias("shared"), F.first("n").alias("n"), F.first("seen").alias("seen"))
            .where(F.col("shared") >= F.col("seen") - _slack(F.col("n"), percent))
            .select("id")
        )
        open_texts = texts.join(open_ids, "id", "left_semi")
    open_texts = cut(open_texts)
    heads = linking.sets_of(open_texts, make, lambda n: slack(n) + 1).select("id", F.explode("tokens").alias("bucket"))
    pivot = cut(linking.pivots(heads))
    certain, near_pivot = linking.around_pivots(open_texts, linking.with_component(pivot, labels), make, percent)
    tokens = linking.with_component(linking.sets_of(open_texts, make), labels).select(
        "id", "n", "component", F.explode("tokens").alias("token")
    )
    ordered = (
        may_match(tokens, "token", holders, "token")
        .join(holders, "token")
        .repartition("id")
        .groupBy("id", "n", "component")
        .agg(F.sort_array(F.collect_list(F.struct("holders", "token"))).alias("items"))
    )
    pairs = linking.across(_prefixes(ordered, percent).join(pivot, "id"), percent).union(near_pivot)
    # A doc_id on several rows ties their classes together.
    classed = members.where("rep is not null")
    split = classed.groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    ties = classed.join(split.select("id"), "id", "left_semi").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    links = linking.verify(pairs, open_texts, make, percent).union(certain).union(ties)
    return members, linking.relabel(labels, links)


@tidy
def jaccard_components(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs.

    Rows with the same doc_id are one node of the graph.  A row without words (or null text)
    has no shingles and is a component by itself; a null doc_id links with nothing and has
    a null component_id.  An empty table gives no rows.
    """
    members, labels = similar_classes(docs, width, percent)
    named = members.join(
        labels.select(F.col("id").alias("rep"), F.col("component").alias("top")), "rep", "left"
    ).select("id", "n", F.coalesce("top", "rep", "id").alias("component"))
    lost = docs.where(F.col("doc_id").isNull()).select("text")
    bare = linking.sets_of(lost.select(F.lit(0).cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")), lambda x: shingle_sets(x, width))
    return named.select(
        F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id")
    ).union(
        bare.select(F.lit(None).cast("long"), F.col("n").cast("long"), F.lit(None).cast("long"))
    )


def keep_one(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay: of each component, what has its smallest doc_id.

    Rows without words and rows without doc_id stay; rows that repeat a doc_id stay or go together.
    """
    found = jaccard_components(docs.select("doc_id", "text"), width, percent)
    leave = found.where(F.col("doc_id").isNotNull() & (F.col("doc_id") > F.col("component_id"))).select(
        F.col("doc_id").alias("tm_leave")
    ).distinct()
    leave = cut(leave)
    hit = fresh(docs, "hit")
    marked = may_match(docs, "doc_id", leave, "tm_leave", flag=hit)
    unsure = marked.where(F.col(hit)).drop(hit)
    left = unsure.join(leave, unsure["doc_id"] == leave["tm_leave"], "left_anti")
    return marked.where(~F.col(hit)).drop(hit).unionByName(left)


JACCARD_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
      ELSE list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g
    FROM d)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n
  HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id)
JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) c USING (doc_id)
"""
