"""Small DataFrame helpers that the operators share."""

from __future__ import annotations

import functools
import itertools
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    found = f"tm_{name}"
    while found.lower() in taken:
        found += "_"
    return found


def same(a: Column, b: Column) -> Column:
    """Equality under which null equals null."""
    return a.eqNullSafe(b)


def work_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: below spark.checkpoint.dir, which is set here only if unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _checkpoint_dir(spark)
    return f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def _checkpoint_dir(spark: SparkSession) -> str:
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    import tempfile

    made = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
    spark.sparkContext.setCheckpointDir(made)
    return made


#: Folders that the operators now running have written, innermost operator last.
_SPENT: list[list[str]] = []
#: Shuffle files go when the query that wrote them ends: its result is in the shared folder then.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Joins whose measured partitions are no larger than what a task reads anyway hash the smaller side, and sort neither.
_HASHED, _ADVISED = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "spark.sql.adaptive.advisoryPartitionSizeInBytes"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for the time of one action."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


#: The broadcasts of an action, and the plans of its stages, stay in the driver's memory until it collects its garbage, which a
#: driver with a heap to grow into puts off: it does so once for so many writes.
COLLECTED = 4
_WRITES = itertools.count(1)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder, without its lineage."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/rows"
    with setting(spark, _CLEANUP, "true"), setting(spark, _HASHED, spark.conf.get(_ADVISED)):
        df.write.parquet(path)
    if not next(_WRITES) % COLLECTED:
        spark._jvm.System.gc()
    if _SPENT:
        _SPENT[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
        folder.getFileSystem(hadoop).delete(folder, True)


def discard(df: DataFrame) -> None:
    """Deletes what cut() wrote for df: for large tables that nothing reads any more while their operator still runs."""
    files = df.inputFiles()
    if files:
        _delete(df.sparkSession, [files[0].rsplit("/", 1)[0]])


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose rows are written to the shared folder, upon which all that it wrote before is deleted.

    For operators with results that are small beside their input: the caller's plan then starts at the result.
    """

    @functools.wraps(operator)
    def run(*args: object, **named: object) -> DataFrame:
        _SPENT.append([])
        try:
            found = operator(*args, **named)
        except BaseException:
            _SPENT.pop()
            raise
        spent = _SPENT.pop()
        kept = cut(found)
        _delete(found.sparkSession, spent)
        return kept

    return run


def slices(batches: Iterable[pa.RecordBatch], rows: int = 400) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``rows`` rows, which share the memory of those they come from.

    Spark bounds a batch by bytes (64 MB, or one longer row); what a task makes of it is bounded by these.
    """
    for batch in batches:
        if not batch.num_rows:
            yield batch
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Rows of 64 bits in a filter; the table that is broadcast has this many at most, 3 MB, however many ids there are.
FILTER_WORDS = 1 << 17


def may_match(df: DataFrame, key: str, ids: DataFrame, id_name: str = "id", flag: str | None = None) -> DataFrame:
    """Rows of df whose key may be among ids (some others too): those alone, or all with a boolean column.

    A bit filter of fixed size: what it lets through still needs the exact join, but most other
    rows need no shuffle.  With more ids than bits it lets everything through.
    """
    slot, word, bits, at = (fresh(df, x) for x in ("slot", "word", "bits", "at"))

    def place(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(FILTER_WORDS * 64))

    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64({id_name}), {FILTER_WORDS * 64}) % 64 as int))")
    words = ids.groupBy(F.floor(place(F.col(id_name)) / 64).cast("long").alias(word)).agg(F.bit_or(bit).alias(bits))
    placed = df.withColumn(slot, place(F.col(key))).withColumn(at, F.floor(F.col(slot) / 64).cast("long"))
    joined = placed.join(F.broadcast(words), F.col(at) == F.col(word), "left")
    hit = F.coalesce(F.expr(f"(shiftright(`{bits}`, cast(pmod(`{slot}`, 64) as int)) & 1L) = 1L"), F.lit(False))
    own = [F.col(f"`{c}`") for c in df.columns]
    return joined.select(*own, hit.alias(flag)) if flag else joined.where(hit).select(*own)


#: Sub-keys of a group; a group's aggregates are joined once for each sub-key that its rows have.
SALTS = 32


def salt(ident: str) -> Column:
    return F.pmod(F.xxhash64(ident), F.lit(SALTS)).cast("int")


def salts(ident: str) -> Column:
    """An aggregate: the sub-keys that a group's rows have, as bits."""
    return F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64({ident}), {SALTS}) as int))"))


def each_salt(bits: str) -> Column:
    """The sub-keys of salts(), a row each."""
    held = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.call_function("shiftright", F.col(bits), i).bitwiseAND(F.lit(1)) == 1)
    return F.explode(held)


def with_group(rows: DataFrame, group: str, ident: str, aggregates: list[Column], having: str | Column) -> DataFrame:
    """rows with the aggregates of their group, of the groups that meet ``having``.

    Groups are summed before the shuffle, and their rows meet the sums by group and a sub-key of ident, so a group
    that holds a third of all rows isn't one task.
    """
    sums = rows.groupBy(group).agg(*aggregates, salts(ident).alias("tm_salts")).where(having)
    sums = sums.withColumn("tm_salt", each_salt("tm_salts")).drop("tm_salts")
    return rows.withColumn("tm_salt", salt(ident)).join(sums, [group, "tm_salt"]).drop("tm_salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
