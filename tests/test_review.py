"""Findings against labels, suppressions, criteria and kinds of files on random and hand-made cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import files
from tidemark.operators import evaluation, triage


def family(cwe):
    return next((n for n, m in evaluation.FAMILIES.items() if cwe in m), f"cwe-{cwe}")


def brute(findings, labels, window):
    """Outcomes one finding after another."""
    real, safe = ([t for t in labels if t[5] == s] for s in (False, True))
    scope, taken, out = {family(t[4]) for t in real}, {}, {}
    for ident, path, start, end, cwes in sorted(findings, key=lambda f: (f[1], f[2], f[0])):
        mine = {family(c) for c in cwes}
        if not path.lower().endswith(evaluation.SUFFIXES):
            out[ident] = ("out_of_scope", None)
            continue
        near = [t for t in real if t[2] == path and (t[3] == 0 or start - window <= t[3] <= end + window) and family(t[4]) in mine]
        if near:
            best = min(near, key=lambda t: (abs(t[3] - start) if t[3] else 0, t[0]))
            out[ident] = ("duplicate" if best[1] in taken else "matched", best[1])
            taken.setdefault(best[1], ident)
            continue
        control = next((t for t in safe if t[2] == path and t[3] and start <= t[3] <= end), None)
        if control and mine and (control[4] == 0 or family(control[4]) in mine):
            out[ident] = ("on_control", control[1])
        else:
            out[ident] = ("false_positive" if mine & scope else "out_of_scope", None)
    return out, {t[1] for t in real} - set(taken)


@pytest.mark.parametrize("seed", [1, 2])
def test_outcomes_follow_brute_force(spark, seed):
    r = random.Random(seed)
    cwes = [89, 943, 79, 77, 330, 566, 9999]
    findings = [(i, r.choice(["a.py", "b.GO", "c.lock"]), s := r.randint(1, 60), s + r.choice([0, 2, 40]), [r.choice(cwes) for _ in range(r.randint(0, 2))]) for i in range(150)]
    labels = [(i, f"L{i}", r.choice(["a.py", "b.GO"]), r.choice([0, r.randint(1, 60), r.randint(1, 60)]), r.choice([0, 564, 87, 78, 384, 639]), r.random() < 0.4) for i in range(40)]
    table = spark.createDataFrame(labels, "no int, label string, path string, line int, cwe int, safe boolean")
    got = evaluation.held_against(spark.createDataFrame(findings, "id int, path string, start int, end int, cwes array<int>"), table)
    expected, missed = brute(findings, labels, 3)
    assert {x.id: (x.outcome, x.label) for x in got.collect()} == expected
    assert {x.label for x in evaluation.missed_labels(table, got).collect()} == missed
    row = evaluation.rates(table, got).first()
    assert (row.missed, row.matched) == (len(missed), sum(o == "matched" for o, _ in expected.values()))
    none = evaluation.rates(table.limit(0), got.limit(0)).first()
    assert (none.matched, none.precision, none.recall, none.f1) == (0, None, None, None)


def test_rules_that_still_hold(spark):
    rows = [(1, "a", "x", "why", None), (2, "b", None, " ok ", "2024-01-02"), (3, "c", "x", "why", "2024-01-01"), (4, "d", "x", "  ", None), (5, None, "x", "why", None)]
    rules = spark.createDataFrame(rows, "rule_no int, rule string, rule_path string, why string, expires string").withColumn("expires", F.col("expires").cast("date"))
    assert sorted(map(tuple, triage.current_rules(rules, F.lit("2024-01-02").cast("date")).collect())) == [(1, "a", "x", "why"), (2, "b", "**", "ok")]


def test_inline_markers(spark):
    text = "a # tide:ignore[R1, CWE-79] - fine\n# tide:ignore: above\nb\nc tide:ignore -- no comment\nd\n<!-- tide:ignore[X*] -->\ne # tide:ignore[]\nf tide:ignored"
    found = [(i, rule, cwe, "p", line) for i, (rule, cwe, line) in enumerate([("R1", 1, 1), ("R2", 79, 1), ("R2", 1, 1), ("Z", 1, 2), ("Z", 1, 3), ("Z", 1, 5), ("X9", 1, 7), ("Y", 1, 7), ("Y", 1, 8)])]
    got = triage.marked_inline(spark.createDataFrame(found, "id int, rule_id string, cwe int, path string, line int"), spark.createDataFrame([("p", text), ("q", None)], "path string, text string"), "tide")
    assert {x.id: x.why for x in got.collect()} == {0: "fine", 1: "fine", 3: "above", 4: "above", 6: None, 7: None}


def test_criteria(spark):
    rows = spark.createDataFrame([(123456, "high", "open", 79, "src/a", 3, "me1"), (2, "low", "fixed", 7, "lib/B", 1, None)], "id long, severity string, status string, cwe int, path string, line int, assignee string")
    pick = lambda **c: [r.id for r in triage.chosen(rows, me="me1", **c).collect()]
    assert pick() == [123456, 2] and pick(severity="LOW,critical") == [2] and pick(cwe="CWE-79") == [123456] and pick(assignee="me") == [123456]
    assert pick(q="lib/b") == [2] and pick(q="F-123456") == [123456] and pick(path="a", status="fixed") == []
    with pytest.raises(ValueError, match="colour"):
        pick(colour="red")


def test_kinds_of_files(spark):
    rows = [
        (1, "a.py", "x\n", (False, False, False, False)), (2, "a.min.css", "x", (False, True, False, False)), (3, "b.js", ";" * 12 + "\nx\n", (False, True, False, False)), (4, "c.js", "y" * 501, (False, True, False, False)),
        (5, "m/vendor/x.go", "a\0", (True, False, False, True)), (6, "x_generated.ts", "", (False, False, True, False)), (7, "y.go", "a\n// DO NOT EDIT\n", (False, False, True, False)), (8, "z.go", "\n" * 5 + "@generated", (False, False, False, False)),
        (9, "vendors/x", "x" * 8192 + "\0", (False, True, False, False)), (10, "w", None, None),
    ]
    table = spark.createDataFrame([r[:3] for r in rows], "id int, p string, t string")
    p, t = F.col("p"), F.col("t")
    got = table.select("id", files.is_binary(F.encode(t, "utf-8")), files.is_minified(p, t), files.is_generated(p, t), files.is_vendored(p)).collect()
    assert {r[0]: tuple(r)[1:] for r in got if r[0] < 10} == {r[0]: r[3] for r in rows if r[0] < 10}


def brute_matches(findings, labels, window):
    best = {}
    for ident, path, line, cwe in findings:
        near = [(abs(t[2] - line), t[0], path, line) for t in labels if (t[1], t[3]) == (path, cwe) and abs(t[2] - line) <= window]
        if near:
            best[ident] = min(near)
    first = {}
    for ident, (_, label, path, line) in best.items():
        first[label] = min(first.get(label, (path, line, ident)), (path, line, ident))
    return {f[0]: (best[f[0]][1], "matched" if first[best[f[0]][1]][2] == f[0] else "duplicate") if f[0] in best else (None, "false_positive") for f in findings}


def test_label_places_meet_once(spark):
    r = random.Random(3)
    findings = [(i, r.choice("ab"), r.randint(1, 30), r.randint(1, 2)) for i in range(300)]
    labels = [(i, r.choice("ab"), r.choice([2, 4, 9, 25]), r.randint(1, 2)) for i in range(100)]
    got = triage.matched(spark.createDataFrame(findings, "id long, path string, line long, cwe int"), spark.createDataFrame(labels, "label long, path string, line long, cwe int"), 3)
    assert {x.id: (x.label, x.outcome) for x in got.collect()} == brute_matches(findings, labels, 3)


def test_label_pairs_do_not_grow_with_a_place(spark):
    """2000 findings and 2000 labels on one line: fewer rows than findings come out of any join inside."""
    findings = spark.range(2000).selectExpr("id", "'a' AS path", "5L AS line", "1 AS cwe")
    labels = spark.range(2000).selectExpr("id AS label", "'a' AS path", "6L AS line", "1 AS cwe")
    got = triage.matched(findings, labels, 3)
    assert got.where("outcome = 'matched'").count() == 1 and got.where("label = 0").count() == 2000
    plan = got._jdf.queryExecution()
    got._jdf.collectToPython()
    rows = []

    def walk(node):
        if "Join" in node.nodeName():
            rows.append(node.metrics().apply("numOutputRows").value())
        inner = node.children() if node.nodeName() != "AdaptiveSparkPlan" else None
        if inner is None:
            walk(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            walk(node.plan())
        else:
            for i in range(inner.size()):
                walk(inner.apply(i))

    walk(plan.executedPlan())
    assert rows and max(rows) <= 2000


def brute_fold(rows, lines):
    out = []
    for ident, path, line, engine, cwe, rank in sorted(rows, key=lambda x: (x[1], x[4], -x[5], x[0])):
        home = next((k for k in out if k["of"] == (path, cwe) and k["engine"] != engine and abs(k["line"] - line) <= lines), None)
        if home is None:
            out.append({"id": ident, "of": (path, cwe), "engine": engine, "line": line, "told": {engine}, "n": 0})
        else:
            home["told"].add(engine)
            home["n"] += 1
    return {(k["id"], ",".join(sorted(k["told"])), k["n"]) for k in out}


def test_correlated_follows_brute_force(spark):
    r = random.Random(5)
    rows = [(i, r.choice("ab"), r.randint(1, 40), r.choice("XXYZ"), r.randint(1, 2), r.randint(0, 3)) for i in range(600)]
    got = triage.correlated(spark.createDataFrame(rows, "id long, path string, line long, engine string, cwe int, rank int"))
    assert {tuple(x) for x in got.collect()} == brute_fold(rows, 2)


def test_correlated_time_is_linear(spark):
    """A group of 40,000 findings of one engine folds on none: each was held against all before it."""
    import time

    rows = spark.range(40000).selectExpr("id", "'a' AS path", "id AS line", "'X' AS engine", "1 AS cwe", "0 AS rank").coalesce(1)
    triage.correlated(rows.limit(10)).count()
    began = time.perf_counter()
    assert triage.correlated(rows).count() == 40000 and time.perf_counter() - began < 20
