"""Links between similar sets, and the components that links make.

A set is the ascending 64-bit hashes that a function makes of a text.  No step emits all
pairs of a bucket: buckets first link their members to two leaders, and only pairs that
are still in different components go on to an exhaustive pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import cut, may_match, salt, slices, with_group

SETS = "id long, n int, tokens array<bigint>"
#: The sets of texts.
Make = Callable[[list[bytes | None]], list[np.ndarray]]

def arrays(column: pa.Array) -> Iterator[np.ndarray]:
    """The rows of an Arrow list column as views of one array."""
    flat = column.values.to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    return (flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True))


def list_column(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.concatenate(rows) if rows else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64), type=pa.int64()))


def _sets(texts: pa.Array, make: Make) -> list[np.ndarray]:
    """The sets of a column of texts, many of which are the same: made once each."""
    packed = texts.cast(pa.binary()).dictionary_encode()
    made = make(packed.dictionary.to_pylist())
    return [made[i] for i in packed.indices.to_pylist()]


def least_overlap(n, percent: int):
    """Tokens of a set of n that a set at this similarity must share at least."""
    return -(-percent * n // 100)


def verify(pairs: DataFrame, texts: DataFrame, make: Make, percent: int) -> DataFrame:
    """The pairs (a, b) for which 100 * |A and B| >= percent * |A or B|, compared exactly.

    Texts (id, text) are shuffled, not sets: they compress, and hashes don't.  Only texts that occur in a pair are.
    """
    pairs = cut(pairs)
    left = may_match(texts, "id", pairs, "a").select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = may_match(texts, "id", pairs, "b").select(F.col("id").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for x, y in zip(*(_sets(batch.column(c), make) for c in ("ta", "tb")), strict=True):
                merged = np.concatenate([x, y])
                merged.sort(kind="stable")  # two ascending runs
                shared = int(np.count_nonzero(merged[1:] == merged[:-1]))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    return both.mapInArrow(check, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for each id of edges (a, b) other than a component's smallest, that smallest.

    Alternating stars: each round hangs neighbours on the smallest one they know, until all edges
    are stars, so the rounds grow with the logarithm of a component's diameter.  Each round is
    written to the shared folder.
    """
    state = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    while not _are_stars(state):
        least = state.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "v")
        large = state.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = cut(hung.union(low.select("u", F.col("m").alias("v"))).distinct())
    return state.select(F.col("u").alias("id"), F.col("v").alias("component"))


def _are_stars(state: DataFrame) -> bool:
    """Whether each u of the distinct edges (u, v) has one v, which is no edge's u."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("up")), F.struct(F.col("v").alias("id"), F.lit(0).alias("up"))))
    ids = state.select(ends.alias("end")).groupBy("end.id").agg(F.sum("end.up").alias("ups"), F.min("end.up").alias("least"))
    return not ids.agg(F.count_if(F.expr("ups > 1 or ups > 0 and least = 0"))).first()[0]


def to_leaders(postings: DataFrame, least_part: float = 0.0) -> DataFrame:
    """Pairs (a, b) of each member with its bucket's smallest and largest id, from (bucket, id, n_buckets).

    least_part: the part of the member's buckets in which they meet, at least.
    """
    leads = with_group(postings, "bucket", "id", [F.min("id").alias("lo"), F.max("id").alias("hi")], "lo < hi")
    met = leads.select("id", "n_buckets", F.explode(F.array("lo", "hi")).alias("lead")).where("id <> lead")
    return (
        met.groupBy("id", "lead")
        .agg(F.count("*").alias("c"), F.first("n_buckets").alias("n_buckets"))
        .where(F.col("c") >= F.greatest(F.lit(1), F.col("n_buckets") * least_part))
        .select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b"))
        .distinct()
    )


#: Members of one component and pivot in a bucket that meet others as one block, and blocks of one pivot that do as one row.
BLOCK_MEMBERS = 256
CROWD_BLOCKS = 64


def _parted(rows: DataFrame, keys: list[str], name: str, most: int) -> DataFrame:
    """rows with a part of their group, so that no part has many more than ``most`` rows."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("held")).where(F.col("held") > most)
    others = [c for c in ("id", "component", "part") if c in rows.columns]
    return rows.join(sizes, keys, "left").withColumn(name, F.pmod(F.xxhash64(*others), F.coalesce(F.ceil(F.col("held") / most), F.lit(1)))).drop("held")


def across(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that meet in enough buckets.

    postings: (bucket, id, n, component, need, free, pivot); free counts tokens that no set of another component holds,
    so two sets share n - free at most, which bounds their similarity.  Pairs of one pivot are left to around_pivots,
    so buckets of one pivot give nothing, and a bucket's members are gathered by pivot: what meets is one pivot's members and another's.
    Inside, they are gathered by component, in blocks, so a large component isn't paired with itself either.
    """
    mixed = postings.groupBy("bucket").agg(F.min("pivot").alias("lo"), F.max("pivot").alias("hi")).where("lo < hi").select("bucket")
    dealt = _parted(cut(postings.join(mixed, "bucket", "left_semi")), ["bucket", "pivot", "component"], "part", BLOCK_MEMBERS)
    blocks = dealt.groupBy("bucket", "pivot", "component", "part").agg(F.collect_list(F.struct("id", "n", "need", "free")).alias("rows"))
    crowds = _parted(blocks, ["bucket", "pivot"], "crowd", CROWD_BLOCKS).groupBy("bucket", "pivot", "crowd").agg(
        F.collect_list(F.struct("component", "rows")).alias("blocks")
    )
    left, right = (crowds.select("bucket", F.col("pivot").alias(f"pivot{k}"), F.col("blocks").alias(f"blocks{k}")) for k in (1, 2))
    met = left.join(right, "bucket").where("pivot1 < pivot2")
    met = met.select(F.explode("blocks1").alias("u"), "blocks2").select("u", F.explode("blocks2").alias("v")).where("u.component <> v.component")
    met = met.select(F.explode("u.rows").alias("x"), F.col("v.rows").alias("rows2")).select("x", F.explode("rows2").alias("y"))
    most = F.least(F.col("x.n") - F.col("x.free"), F.col("y.n") - F.col("y.free"))
    return (
        met.where(100 * most >= percent * (F.col("x.n") + F.col("y.n") - most))
        .select(F.least("x.id", "y.id").alias("id1"), F.greatest("x.id", "y.id").alias("id2"), F.least("x.need", "y.need").alias("need"))
        .groupBy("id1", "id2")
        .agg(F.count("*").alias("c"), F.first("need").alias("need"))
        .where("c >= need")
        .select(F.col("id1").alias("a"), F.col("id2").alias("b"))
    )


def pivots(heads: DataFrame) -> DataFrame:
    """(id, pivot): the set that leads most of an id's buckets, from (id, bucket); a leader of its own buckets is its own."""
    leads = with_group(heads, "bucket", "id", [F.min("id").alias("lead")], "lead is not null")
    met = leads.groupBy("id", "lead").agg(F.count("*").alias("c"))
    return met.groupBy("id").agg(F.max_by("lead", F.struct("c", -F.col("lead"))).alias("pivot"))


def gathered(heads: DataFrame) -> DataFrame:
    """(id, pivot): the smallest id that a chain of leaders ends at, from (id, bucket).

    Each id hangs on the leader, other than itself, of most of its buckets; what leads all its buckets is its own.
    """
    leads = with_group(heads, "bucket", "id", [F.min("id").alias("lead")], "lead is not null")
    met = leads.where("id <> lead").groupBy("id", "lead").agg(F.count("*").alias("c"))
    hung = met.groupBy("id").agg(F.max_by("lead", F.struct("c", -F.col("lead"))).alias("lead"))
    roots = components(hung.select(F.col("id").alias("a"), F.col("lead").alias("b")))
    return with_component(heads.select("id").distinct(), roots).withColumnRenamed("component", "pivot")


#: Pairs a member that a bucket's pivots may make before they are merged.
CROSSED = 4


def merged(heads: DataFrame, pivot: DataFrame) -> DataFrame:
    """pivot (id, pivot), with the pivots of a bucket (bucket, id) as one where their members make more than CROSSED pairs a member.

    What is left for across() grows with the postings then; around_pivots compares the others by differences, whatever their pivot.
    """
    held = heads.join(pivot, "id").groupBy("bucket", "pivot").agg(F.count("*").cast("double").alias("n"))
    sums = held.groupBy("bucket").agg(F.min("pivot").alias("lead"), F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    crowded = sums.where((F.col("all") * F.col("all") - F.col("squares")) / 2 > CROSSED * F.col("all")).select("bucket", "lead")
    roots = components(held.join(crowded, "bucket").select(F.col("pivot").alias("a"), F.col("lead").alias("b")))
    named = roots.select(F.col("id").alias("pivot"), F.col("component").alias("root"))
    return pivot.join(named, "pivot", "left").select("id", F.coalesce("root", "pivot").alias("pivot"))


def around_pivots(
    texts: DataFrame, placed: DataFrame, make: Make, percent: int
) -> tuple[DataFrame, DataFrame]:
    """(links, pairs) between sets of one pivot, (a, b): links are certain, pairs are to be verified.

    placed: (id, component, pivot).  With D(x) the symmetric difference of x and the pivot, that of x and y is
    |D(x)| + |D(y)| - 2 |D(x) and D(y)|.  So x and y are similar if and only if the differences share
    (e(x) + e(y)) / 2 tokens, where e(x) = |D(x)| - b |x| and b = (1 - t) / (1 + t).  Where the
    sum isn't positive the link is certain, and the set of the least e has a link to either; else the rarest tokens
    of the differences must meet.  Near copies of one text differ from it in few tokens that others
    share, so a large group of them gives few pairs.
    """
    # A pivot's text is sent once for each sub-key of its group.
    led = placed.withColumn("salt", salt("id"))
    left = texts.select(F.col("id").alias("pivot"), F.col("text").alias("tp")).join(led.select("pivot", "salt").distinct(), "pivot")
    both = led.join(left, ["pivot", "salt"]).join(texts, "id").select("id", "component", "pivot", "text", "tp")
    plus, minus = 100 + percent, 100 - percent

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, rows = [], []
            for x, p in zip(*(_sets(batch.column(c), make) for c in ("text", "tp")), strict=True):
                sizes.append(len(x))
                rows.append(np.setxor1d(x, p, assume_unique=True))
            yield pa.record_batch(
                [*batch.select(["id", "component", "pivot"]).columns, pa.array(sizes, type=pa.int32()), list_column(rows)],
                names=["id", "component", "pivot", "n", "tokens"],
            )

    found = cut(both.mapInArrow(differ, "id long, component long, pivot long, n int, tokens array<bigint>"))
    found = found.select(
        "id", "component", "pivot", "tokens", F.size("tokens").alias("d"), (F.size("tokens") * plus - F.col("n") * minus).alias("e")
    )
    rows = with_group(found, "pivot", "id", [F.min_by("id", F.struct("e", "id")).alias("best"), F.min("e").alias("low")], "low is not null")
    links = rows.where("e + low <= 0 and id <> best").select(F.least("id", "best").alias("a"), F.greatest("id", "best").alias("b"))

    tokens = rows.select("id", "component", "pivot", "d", "e", "low", F.explode("tokens").alias("token"))
    held = tokens.groupBy("pivot", "token").agg(F.count("*").alias("holders"), F.min("e").alias("least")).where("holders > 1")
    # Lists are gathered after the shuffle: before it, a task has few rows of each.
    items = (
        tokens.join(held, ["pivot", "token"])
        .repartition("id")
        .groupBy("id", "component", "pivot", "d", "e", "low")
        .agg(F.sort_array(F.collect_list(F.struct("holders", "token", "least"))).alias("items"))
        .withColumn("shared", F.size("items"))
    )
    need = F.greatest(F.lit(1), F.ceil((F.col("e") + F.col("low")) / (2 * plus)))
    # The tokens that nobody else holds come first in a prefix, and can't meet.
    length = F.greatest(F.lit(0), F.col("shared") - need + 1)
    # The first token that two sets share, at places i and j, leaves room for so many more after it.
    postings = items.select(
        "id", "component", "pivot", "e", "shared", F.posexplode(F.slice("items", F.lit(1), length.cast("int"))).alias("at", "item")
    ).select("id", "component", "pivot", "e", F.col("item.token").alias("token"), (F.col("shared") - F.col("at")).alias("room"), "item.least")
    # What no holder of the token leaves room for meets nothing there: sets far from the pivot that share its tokens alone.
    postings = postings.where(2 * plus * F.col("room") >= F.col("e") + F.col("least"))
    names = ("id", "component", "e", "room")
    a = postings.select("pivot", "token", *(F.col(c).alias(f"{c}1") for c in names))
    b = postings.select("pivot", "token", *(F.col(c).alias(f"{c}2") for c in names))
    pairs = (
        a.join(b, ["pivot", "token"])
        .where("component1 < component2 and e1 + e2 > 0")
        .where(2 * plus * F.least("room1", "room2") >= F.col("e1") + F.col("e2"))
        .select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b"))
        .distinct()
    )
    return links, pairs


def with_component(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with the component of their id, its own id if labels don't name it."""
    return rows.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))


def relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links between ids."""
    links = cut(links)
    if links.isEmpty():
        return labels
    old = labels.select(F.col("id").alias("a"), F.col("component").alias("b"))
    return components(old.union(links.select("a", "b")))


def sets_of(
    texts: DataFrame, make: Make, part: Callable[[int], int] | None = None
) -> DataFrame:
    """(id, n, tokens) of (id, text): the size of the set, and the set or its part(n) smallest hashes."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = make(batch.column("text").cast(pa.binary()).to_pylist())
            sizes = pa.array([len(r) for r in rows], type=pa.int32())
            if part is not None:
                rows = [r[: part(len(r))] for r in rows]
            yield pa.record_batch([batch.column("id"), sizes, list_column(rows)], names=["id", "n", "tokens"])

    return texts.select("id", "text").mapInArrow(tokens, SETS)
