"""What the driver and the tasks spend on joins, components and repeats, and that results stay as they were."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import frames, linking, substring, textkit


def _components(spark, edges):
    found = linking.components(spark.createDataFrame(edges, "a long, b long"))
    return {r["id"]: r["component"] for r in found.collect()}


def test_components_of_stars_take_no_round(spark, monkeypatch):
    writes = []
    monkeypatch.setattr(linking, "cut", lambda df: writes.append(1) or frames.cut(df))
    assert _components(spark, [(2, 1), (1, 3), (5, 4), (6, 6)]) == {2: 1, 3: 1, 5: 4}
    assert len(writes) == 1


def test_components_of_chains_and_rings(spark):
    order = np.random.default_rng(5).permutation(60).tolist()
    edges = [(order[i], order[i + 1]) for i in range(39)] + [(order[40 + i], order[40 + (i + 1) % 20]) for i in range(20)]
    low = [min(order[:40])] * 40 + [min(order[40:])] * 20
    assert _components(spark, edges) == {x: y for x, y in zip(order, low, strict=True) if x != y}


def test_writes_free_the_drivers_memory(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Young" not in b.getName())
    before = full()
    for _ in range(frames.COLLECTED):
        frames.cut(spark.range(3).toDF("x"))
    assert full() > before


def test_measured_joins_are_hashed(spark):
    seen = []
    real = frames.setting

    def watched(session, key, value):
        seen.append(key)
        return real(session, key, value)

    frames.setting, kept = watched, frames.setting
    try:
        frames.cut(spark.range(3).toDF("x"))
    finally:
        frames.setting = kept
    assert "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold" in seen


def test_passages_of_ids_beyond_a_half_long(spark):
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    common = text(45)
    rows = [(i, f"{text(20)} {common} {text(9)}.\n{text(30)}") for i in (-7, 3, 11)] + [(20, text(60))]
    shift = 1 << 40
    near = substring.passages(spark.createDataFrame(rows, "doc_id long, text string"))
    far = substring.passages(spark.createDataFrame([(i + shift, t) for i, t in rows], "doc_id long, text string"))
    moved = far.withColumns({c: F.col(c) - shift for c in ("doc_id", "first_doc_id")})
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, moved.collect()))
    assert near.where("removed").count() == 2


def test_places_are_packed_where_ids_fit(spark):
    docs = spark.createDataFrame([(1, "a"), ((1 << 31) - 1, "b")], "doc_id long, text string")
    assert substring._narrow(docs) and not substring._narrow(docs.withColumn("doc_id", F.col("doc_id") + 1))


def test_least_places_and_distinct_hashes():
    rng = np.random.default_rng(1)
    for n in (19, 20, 64, 500):
        values = rng.integers(0, 40, n).astype(np.uint64)
        rows = np.lib.stride_tricks.sliding_window_view(values, 19)
        assert (substring.least_places(values, 19) == rows.argmin(axis=1) + np.arange(len(rows))).all()
        assert (textkit.distinct(values) == np.unique(values)).all()
    assert not len(textkit.distinct(values[:0]))
