"""Steps whose shuffles, memory or rows must grow no faster than their input."""

from __future__ import annotations

import re

from tidemark.operators import evaluation, graph, regions, secrets, terms


def test_findings_meet_labels_without_joins_by_id(spark):
    findings = [
        (1, "a.py", 100, 300, [89]),  # longer than any cell: its labels lie in many
        (2, "a.py", 298, 298, [89]),
        (3, "a.py", 7, 8, [79]),
        (4, "a.py", 23, 24, [79, 87]),
        (5, "b.py", 1, 2, [22]),
        (6, "b.lock", 1, 2, [22]),
        (7, None, 1, 2, [89]),
        (8, "c.py", 1, 200, [327]),
        (9, "c.py", 5, 6, None),
    ]
    labels = [
        (1, "L1", "a.py", 301, 89, False), (2, "L2", "a.py", 160, 564, False), (3, "L3", "a.py", 4, 83, False), (4, "L4", "a.py", 27, 80, False),
        (5, "L5", "b.py", 0, 23, False), (6, "L6", "c.py", 150, 326, True), (7, "L7", "c.py", 190, 0, True), (8, "L8", "c.py", 5, 0, True),
    ]
    got = evaluation.held_against(
        spark.createDataFrame(findings, "id int, path string, start int, end int, cwes array<int>"),
        spark.createDataFrame(labels, "no int, label string, path string, line int, cwe int, safe boolean"),
    )
    assert {x.id: (x.outcome, x.label) for x in got.collect()} == {
        1: ("matched", "L2"), 2: ("matched", "L1"), 3: ("matched", "L3"), 4: ("matched", "L4"), 5: ("matched", "L5"), 6: ("out_of_scope", None),
        7: ("out_of_scope", None), 8: ("on_control", "L6"), 9: ("out_of_scope", None),
    }
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 1  # a label's findings meet its first; none is joined by id


def test_slices_are_added_up_without_joins_a_slice(spark):
    segments = spark.createDataFrame(
        [(1, "a", 1, 400, 5), (1, "a", 200, 260, 7), (1, "b", 1, 10, None), (2, "c", 5, 6, 1), (None, "a", 1, 2, 3)], "slice int, path string, start int, end int, tokens long"
    )
    functions = spark.createDataFrame([("a", "f", 100, 300), ("a", "f", 390, 395), ("a", "g", 260, 270), ("b", "f", 10, 12), ("b", None, 9, 9), ("b", "h", 11, 20)], "path string, name string, start int, end int")
    files = spark.createDataFrame([("a", 1000), ("b", 100)], "path string, lines int")
    found = regions.slice_disclosure(segments, functions, files)
    got = {r["slice"]: tuple(r)[1:5] for r in found.collect()}
    assert got == {1: (471, 12, 4, 2), 2: (2, 1, 0, 0), None: (2, 3, 0, 0)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 3  # files, functions and the repository's one row


def test_words_with_a_hit_are_few_and_placed_without_a_pattern_each(spark):
    docs = spark.createDataFrame([(1, "xredfox Redfox, \U0001F600 red"), (2, "\u00e9red (darkred) \U00010400red"), (3, "blue-red_ red"), (4, None), (5, "none")], "id int, text string")
    originals = spark.createDataFrame([("red",), ("fox",)], "v string")
    found = terms.original_hits(docs, "id", "text", originals, None, ("darkred",))
    brute = {}
    for i, t in ((r.id, (r.text or "").lower()) for r in docs.collect()):
        words = [(m.start(), m[0]) for m in re.finditer(r"\w+", t) if m[0] != "darkred"]
        hits = [p + k for p, w in words for v in ("red", "fox") for k in range(len(w)) if w.startswith(v, k)]
        if hits:
            brute[i] = (len(hits), min(hits))
    assert {r["ident"]: (r["hits"], r["first"]) for r in found.collect()} == brute
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [ident" in plan and "regexp_instr" not in plan and "ident#" in plan and not re.search(r"Aggregate \[ident#\d+, word#\d+\]", plan)


def test_texts_become_strings_a_few_at_a_time(spark):
    docs = spark.range(1000).selectExpr("id", "concat('key = \"', sha2(cast(id as string), 256), '\" é') AS text")
    found = secrets.spans(docs, "id", "text", secrets.TOKENS)
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()  # not whole batches as strings of pandas
    assert found.select("ident", "start_byte", "value").distinct().count() == 1000
    assert {(r.start_byte, r.end_byte) for r in found.collect()} == {(7, 71)}


def test_components_end_at_stars_and_not_at_a_sum_over_all_edges(spark, monkeypatch):
    """A sum of hashes of 40 bits is beyond a long from 2^24 edges on, and takes a round more."""
    written = []
    monkeypatch.setattr(graph, "stored", lambda rows, write=graph.stored: written.append(write(rows)) or written[-1])
    found = graph.components(spark.createDataFrame([(9, 1), (1, 5), (7, 1), (3, 4)], "a long, b long"))
    assert {x.node: x.component for x in found.collect()} == {1: 1, 5: 1, 7: 1, 9: 1, 3: 3, 4: 3}
    assert len(written) == 1
