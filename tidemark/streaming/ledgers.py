"""Ledgers as a stream: each one's last hash, sequence and time are carried over micro-batches, so a run resumes where the last one stopped."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.triage import GENESIS

REPORT = "entries long, first_bad long, reason string"
STATE = "entries long, hash string, seq long, micros long, first_bad long, reason string"


def _fault(row: tuple, before: tuple[str, int, int] | None) -> str | None:
    """The first thing that is wrong with an entry (body, seq, micros, prev_hash, entry_hash) after the one before it (hash, seq, micros)."""
    body, seq, micros, previous, own = row
    if hashlib.sha256(body.encode()).hexdigest() != own:
        return "entry hash"
    if before is None:
        return None if seq == 1 and previous == GENESIS else "genesis"
    if seq != before[1] + 1:
        return "sequence"
    if previous != before[0]:
        return "previous hash"
    return "time" if micros < before[2] else None


def followed(entries: DataFrame, key: str, order: str) -> DataFrame:
    """(key, entries, first_bad, reason) of each ledger that a micro-batch touched, over all of it so far.

    entries: a stream of (key, order, body, seq, ts, prev_hash, entry_hash).  A batch's entries of one ledger are put in order; one that comes in a
    later batch than its successors is a fault in the sequence.  A task holds one ledger's entries of one micro-batch.
    """
    rows = entries.select(key, order, "body", "seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "prev_hash", "entry_hash")
    kind = dict(rows.dtypes)[key]

    def follow(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, last, seq, micros, first_bad, reason = state.get if state.exists else (0, None, 0, 0, None, None)
        before = None if last is None else (last, seq, micros)
        batch = pd.concat(list(parts)).sort_values(order, kind="stable")
        for row in batch[["body", "seq", "micros", "prev_hash", "entry_hash"]].itertuples(index=False, name=None):
            fault = _fault(row, before)
            if fault is not None:
                first_bad = row[1] if first_bad is None else min(first_bad, row[1])
                reason = reason or fault
            before = (row[4], row[1], row[2])
            count += 1
        state.update((count, *before, first_bad, reason))
        yield pd.DataFrame({key: [name[0]], "entries": [count], "first_bad": pd.array([first_bad], dtype="Int64"), "reason": pd.array([reason], dtype="string")})

    return rows.groupBy(key).applyInPandasWithState(follow, f"{key} {kind}, {REPORT}", STATE, "update", GroupStateTimeout.NoTimeout)


def run_to_end(entries: DataFrame, key: str, order: str, folder: str) -> DataFrame:
    """Reads what is there of a stream of entries, from where the last run on ``folder`` stopped, and gives the report of all ledgers so far."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    run = followed(entries, key, order).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start()
    run.awaitTermination()
    out = entries.sparkSession.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out")
    last = out.groupBy(key).agg(F.max_by(F.struct("entries", "first_bad", "reason"), "batch").alias("v"))
    return last.select(key, "v.entries", F.col("v.reason").isNull().alias("ok"), "v.first_bad", "v.reason")
