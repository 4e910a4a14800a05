from __future__ import annotations

import math

import pytest

from pyspark.sql import functions as F
from tidemark.functions import text as T
from tidemark.operators import findings, graph, matching, temporal, triage


def test_luhn(spark):
    rows = spark.createDataFrame([("4111111111111111",), ("4111111111111112",), ("79927398713",)], "d string")
    assert [r[0] for r in rows.select(T.luhn_valid(F.col("d"))).collect()] == [True, False, True]


@pytest.mark.parametrize(("token", "bits"), [("aaaa", 0.0), ("abab", 1.0), ("abcd", 2.0), ("aab", 0.9182958340544896)])
def test_entropy(spark, token, bits):
    got = spark.createDataFrame([(token,)], "t string").select(T.shannon_entropy(F.col("t"))).first()[0]
    assert math.isclose(got, bits, abs_tol=1e-9)


def test_band_pairs_cross_cells(spark):
    rows = spark.sql(
        "SELECT * FROM VALUES (1, 1, timestamp'2024-01-01 00:01:59'), (1, 2, timestamp'2024-01-01 00:02:01'), "
        "(1, 3, timestamp'2024-01-01 00:05:00'), (2, 4, timestamp'2024-01-01 00:02:00') AS t(u, i, ts)"
    )
    got = {(r.a, r.b) for r in temporal.band_pairs(rows, "u", "ts", "i", 120).collect()}
    assert got == {(1, 2)}


def test_delta_states(spark):
    a = spark.createDataFrame([("x",), ("y",)], "k string")
    b = spark.createDataFrame([("y",), ("z",)], "k string")
    assert {tuple(r) for r in findings.delta(a, b, "k").collect()} == {("x", "fixed"), ("y", "unchanged"), ("z", "new")}


def test_reachable_with_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "a long, b long")
    roots = spark.createDataFrame([(1,)], "node long")
    assert {r.node for r in graph.reachable(edges, roots).collect()} == {1, 2, 3}


def test_union_seconds(spark):
    rows = spark.createDataFrame([("k", 0, 10), ("k", 5, 20), ("k", 30, 40)], "k string, s long, e long")
    assert [tuple(r) for r in temporal.union_seconds(rows, "k", "s", "e").collect()] == [("k", 2, 30)]


def test_greedy_fold(spark):
    rows = spark.createDataFrame([("a", 0, 1), ("a", 500, 2), ("a", 700, 3), ("a", 1200, 4), ("b", 10, 5)], "k string, t long, i long")
    got = {r.id: r.group_id for r in matching.greedy_fold(rows, "k", "t", "i", 600).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_bootstrap_covers_the_mean(spark):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") % 4 == 0).cast("int").alias("toxic"))
    mean, low, high = matching.poisson_bootstrap(rows, "doc_id", "toxic", 200).first()
    assert abs(mean - 0.25) < 0.01 and 0.2 < low < 0.25 < high < 0.3


def test_short_canaries_are_searched(spark):
    docs = spark.createDataFrame([(1, "an alpha beta text"), (2, "xalphay"), (3, "none"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha"), (2, "alpha be"), (3, "an alpha beta"), (4, "zeta"), (5, "")], "item_id long, canary string")
    got = {r.item_id: r.exposed_in for r in matching.substring_counts(docs, items).collect()}
    assert got == {1: 2, 2: 1, 3: 1, 4: 0, 5: 3}
    assert {r.exposed_in for r in matching.substring_counts(docs, items.where("item_id = 3")).collect()} == {1}


def test_correlated_equals_plain_fold(spark):
    import random

    r = random.Random(3)
    rows = [(i, r.choice("ab"), r.randint(1, 60), r.choice("XYZ"), r.randint(1, 2), r.randint(0, 4)) for i in range(150)]
    kept = []
    for i, path, line, engine, cwe, rank in sorted(rows, key=lambda x: (-x[5], x[0])):
        home = next((k for k in kept if k[1] == path and k[4] == cwe and k[3] != engine and abs(k[2] - line) <= 2), None)
        if home is None:
            kept.append([i, path, line, engine, cwe, {engine}, 0])
        else:
            home[5].add(engine)
            home[6] += 1
    docs = spark.createDataFrame(rows, "id long, path string, line long, engine string, cwe int, rank int")
    got = {(x.id, x.engines, x.folded) for x in triage.correlated(docs).collect()}
    assert got == {(k[0], ",".join(sorted(k[5])), k[6]) for k in kept}


def test_chain_faults(spark):
    import hashlib

    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()

    def chain(key, change):
        rows, last = [], "0" * 64
        for n in range(1, 5):
            row = {"k": key, "n": n, "body": f"{key}{n}", "seq": n, "ts": n * 10, "prev_hash": last, "entry_hash": digest(f"{key}{n}")}
            last = row["entry_hash"]
            rows.append(row | change.get(n, {}))
        return rows

    rows = chain("good", {}) + chain("gap", {3: {"seq": 4}}) + chain("time", {4: {"ts": 1}}) + chain("hash", {2: {"entry_hash": "x"}}) + chain("start", {1: {"prev_hash": "y"}})
    entries = spark.createDataFrame(rows, "k string, n long, body string, seq long, ts long, prev_hash string, entry_hash string")
    got = {x.k: (x.ok, x.first_bad, x.reason) for x in triage.verified_chains(entries, "k", "n").collect()}
    assert got == {
        "good": (True, None, None), "gap": (False, 4, "sequence"), "time": (False, 4, "time"), "hash": (False, 2, "entry hash"), "start": (False, 1, "genesis"),
    }


def test_nearest_before_within_a_second(spark):
    """Of clicks in one second the latest counts, of equals the smallest id; rows without a key or a click before are kept with null."""
    rows = spark.createDataFrame(
        [("c", 9, 1, 10, 5), ("c", 8, 1, 10, 7), ("c", 7, 1, 10, 7), ("c", 6, None, 1, 1), ("v", 1, 1, 10, 0), ("v", 2, 1, 9, 9), ("v", 3, None, 20, 0), ("v", 4, 2, 20, 0), ("v", 5, 1, 99, 0)],
        "kind string, id long, u long, t long, part long",
    )
    left, right = rows.where("kind = 'v'"), rows.where("kind = 'c'")
    got = matching.nearest_before(left, right, "u", "t", "id", 50, "part", outer=True)
    assert {r.left_id: r.right_id for r in got.collect()} == {1: 7, 2: None, 3: None, 4: None, 5: None}
    assert [tuple(r) for r in matching.nearest_before(left, right, "u", "t", "id", 50).collect()] == [(1, 7)]
