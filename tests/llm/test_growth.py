"""Pairs that large groups make: no more than in proportion to their members."""

from __future__ import annotations

import itertools
import random

import numpy as np

from tests.llm.conftest import DOCS, words
from tidemark.llm import linking, substring, textkit


def test_a_crowded_buckets_pivots_are_one_and_small_ones_stay(spark):
    crowded = [(1, k) for k in range(200)]
    small = [(2, k) for k in range(300, 304)]
    heads = spark.createDataFrame(crowded + small, "bucket long, id long")
    pivot = spark.createDataFrame([(k, k % 2) for _, k in crowded] + [(k, 300 + k % 2) for _, k in small], "id long, pivot long")
    got = {r["id"]: r["pivot"] for r in linking.merged(heads, pivot).collect()}
    assert {got[k] for _, k in crowded} == {0}
    assert {got[k] for _, k in small} == {300, 301}
    rows = heads.join(spark.createDataFrame(list(got.items()), "id long, pivot long"), "id")
    assert rows.where("bucket = 1").select("pivot").distinct().count() == 1  # across() pairs pivots with each other alone


def test_families_far_from_their_pivot_lose_no_link(spark):
    chance = np.random.default_rng(5)
    families = [chance.choice(10**6, 24, replace=False) for _ in range(3)]
    sets = {0: np.sort(families[0])}
    for k in range(1, 90):
        own = families[k % 3].copy()
        own[chance.choice(24, int(chance.integers(0, 5)), replace=False)] = chance.integers(10**6, 10**6 + 40, 1)[0] + np.arange(1)
        sets[k] = np.unique(own)
    texts = spark.createDataFrame([(k, " ".join(map(str, v.tolist())).encode()) for k, v in sets.items()], "id long, text binary")
    placed = spark.createDataFrame([(k, k, 0) for k in sets], "id long, component long, pivot long")

    def make(rows):
        return [np.array(sorted(map(int, r.split())), dtype=np.int64) for r in rows]

    links, pairs = linking.around_pivots(texts, placed, make, 80)
    found = linking.relabel(spark.createDataFrame([], "id long, component long"), linking.verify(pairs, texts, make, 80).union(links))
    got = {r["id"]: r["component"] for r in found.collect()}
    lead = {k: k for k in sets}
    for a, b in itertools.combinations(sets, 2):
        shared = len(np.intersect1d(sets[a], sets[b]))
        if 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
            x, y = sorted((lead[a], lead[b]))
            lead = {k: x if v == y else v for k, v in lead.items()}
    assert {k: got.get(k, k) for k in sets} == lead
    assert pairs.count() < 90 * 89 // 2


def test_units_that_a_buckets_leaders_met_are_not_compared_again(spark, monkeypatch):
    """What a bucket's smallest and largest unit were verified with is done; its other units still find each other."""
    r = random.Random(3)
    key = lambda t: int(substring.run_hashes(h := textkit.word_hashes(t.encode()), np.array([0]), np.array([len(h)])).view(np.int64)[0])
    base = words(r, 40)
    near = [base, base.rsplit(" ", 1)[0] + " changed"]
    far = sorted((words(r, 40) for _ in range(60)), key=key)
    texts = [far[0], *near, far[-1]]
    assert key(texts[0]) < min(map(key, near)) and max(map(key, near)) < key(texts[-1])
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate([*texts, *far[1:3]])], DOCS)
    met = [(key(t), 1, 7) for t in texts] + [(key(t), 1, 8) for t in (texts[0], *far[1:3])]
    compared = []
    monkeypatch.setattr(linking, "gathered", lambda heads, gather=linking.gathered: compared.append(heads.count()) or gather(heads))
    found = substring.unit_components(docs, spark.createDataFrame(met, "key long, n_buckets int, bucket long"))
    low, high = sorted(map(key, near))
    assert {x.id: x.component for x in found.collect()} in ({high: low}, {high: low, low: low})
    assert compared == [2]  # all four of bucket 7 before, and the three of bucket 8
