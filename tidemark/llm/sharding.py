"""Proportional stratified interleaving: shards of equal counts that each hold all sources in proportion.

Rows of a source are ranked in a seeded random order; a row's fractional rank is its place in its source as a part of 1.
In the order of fractional ranks every stretch holds the sources in proportion, so this order, cut into equal
parts, gives the shards.  Ranks come from counts of parts and places inside parts, in both steps: parts of a source by the
leading bits of its rows' keys, and parts of the whole by fractional rank.  So a task holds a part's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.frames import cut, fresh, tidy

SHARDS = 24
SEED = 20240
#: Rows of a part, about, and the fewest parts.
PART_ROWS = 20_000
LEAST_PARTS = 64
#: Bytes that a record takes besides its text.
RECORD_BYTES = 8


def shuffle_key(*values: Column, seed: int = SEED) -> Column:
    """A seeded random key of a row, in hexadecimal digits: rows in its order are in a random order, the same each time."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(v.cast("string"), F.lit("-")) for v in values)))


def _with_ahead(rows: DataFrame, group: list[str], part: str, names: tuple[str, str]) -> DataFrame:
    """rows with two counts more: of their group's rows in earlier parts, and of all its rows.  The windows run over a row for each part."""
    over = Window.partitionBy(*(group or [F.lit(0)]))
    before = over.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*group, part).agg(F.count("*").alias("n"))
    sums = counts.select(*group, part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(names[0]), F.sum("n").over(over).alias(names[1]))
    return rows.join(sums, [*group, part])


def interleaved(docs: DataFrame, key: Column, shards: int = SHARDS, strata: str = "source") -> DataFrame:
    """docs with ``shard``, 0 to shards - 1, and ``slot``, gapless from 0 in each shard.

    Shards' counts are at most one apart, and each shard has as many rows of a source as its share of all rows asks for, but
    for one row at each end.  ``key`` is a shuffle_key(); rows of a source with equal keys may change places with each other, all
    others have one place.  A null source is a source of its own.  Repeated rows are rows of their own.  An empty
    table gives no rows; with fewer rows than shards, some shards are empty.  All columns of docs are carried through two exchanges, so callers
    select what they need; docs' own columns ``shard`` and ``slot`` are replaced.
    """
    k, named, part, rank, ahead, every, share = (fresh(docs, x) for x in ("key", "named", "part", "rank", "ahead", "every", "share"))
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")]
    rows = cut(docs.select(*own, key.alias(k), F.coalesce(F.concat(F.lit("="), F.col(f"`{strata}`")), F.lit("")).alias(named)))
    total = rows.count()
    parts = max(LEAST_PARTS, -(-total // PART_ROWS))
    lead = F.conv(F.substring(k, 1, 8), 16, 10).cast("long")
    inside = Window.partitionBy(named, part).orderBy(k)
    ranked = (
        _with_ahead(rows.withColumn(part, F.floor(lead * parts / (1 << 32))), [named], part, (ahead, every))
        .withColumn(rank, F.col(ahead) + F.row_number().over(inside) - 1)
        .select(*own, named, rank, ((2 * F.col(rank) + 1) / (2 * F.col(every))).alias(share))
    )
    ranked = cut(ranked).withColumn(part, F.floor(F.col(share) * parts))
    order = Window.partitionBy(part).orderBy(share, named, rank)
    placed = _with_ahead(ranked, [], part, (ahead, every)).withColumn(rank, F.col(ahead) + F.row_number().over(order) - 1)
    found = placed.select(*own, F.expr(f"cast(`{rank}` * {shards} div {max(total, 1)} as int) AS shard"), rank)
    return found.select(*own, "shard", F.expr(f"`{rank}` - (shard * {total}L + {shards - 1}) div {shards} AS slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, tasks: int = 200) -> None:
    """The shards as Parquet below ``path``, a folder ``shard=k`` each, whose files hold the documents in order of ``slot``.

    Files are stretches of slots, so a large shard is written by many tasks.
    """
    placed = interleaved(docs, shuffle_key(F.col("doc_id"), F.xxhash64("text"), seed=seed), shards)
    placed.repartitionByRange(tasks, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


@tidy
def sharded_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, source) for each row of docs: where interleaved() puts it.

    A null text has no bytes: size 8 and CRC 0.  Texts themselves are read once and never shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    sized = docs.select(
        "doc_id", "source", (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    placed = interleaved(sized, shuffle_key(F.col("doc_id"), F.col("text_crc32")), shards)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


SHARD_SQL = r"""
WITH crc AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS tab
  FROM range(256) t(i)
), d AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 8 AS size,
         xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT),
             lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32
  FROM documents, crc
), r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('20240:' || coalesce(doc_id::VARCHAR, '-') || ':' || text_crc32)) - 1 AS r,
         count(*) OVER (PARTITION BY source) AS n
  FROM d
), p AS (
  SELECT *, row_number() OVER (ORDER BY (2 * r + 1)::DOUBLE / (2 * n), coalesce('=' || source, ''), r) - 1 AS p, count(*) OVER () AS total FROM r
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (p * 24 // total)::INT AS shard,
       p - ((p * 24 // total) * total + 23) // 24 AS slot, NULL::INT AS grown_shard, source
FROM p
"""
