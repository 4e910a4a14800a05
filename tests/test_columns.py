"""Column functions on known answers, and ledgers that stop and resume."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.functions import codes, formats, scalars
from tidemark.operators import graph, risk, triage
from tidemark.streaming import ledgers

CHECKS = [
    ("iban", "GB82 WEST 1234 5698 7654 32", True), ("iban", "de89370400440532013000", True), ("iban", "GB82WEST12345698765433", False), ("iban", "XX00", False), ("iban", "GB82-EST12345698765432", False),
    ("gstin", "27AAPFU0939F1ZV", True), ("gstin", "27AAPFU0939F1ZW", False), ("gstin", "27AAPFU0939F1Z", False), ("gstin", "27aapfu0939f1zv", False),
    ("birth", "31/12/1999", True), ("birth", "12-31-1999", True), ("birth", "31.13.1999", False), ("birth", "1999-02-29", False), ("birth", "2000-02-29", True), ("birth", "1/1/1899", False), ("birth", "x/1/1999", False),
    ("card", "4111111111111111", True), ("card", "4111111111111112", False), ("card", "5105105105105100", True), ("card", "378282246310005", True), ("card", "1234567812345670", False), ("card", "79927398713", False),
]
PATHS = [("a//b/./c.py", "a/b/c.py"), ("a\\b.py", "a/b.py"), ("/etc/x", None), ("a/../b", None), ("C:/x", None), ("./C:", None), ("a/", None), ("", None), (".", None), ("src/ok.py", "src/ok.py")]
WORDS = [("accountIDForKYC_2", "account ID For KYC 2"), ("__init__", "init"), ("HTTPServer2x", "HTTP Server 2 x"), ("a", "a"), ("", ""), ("snake_case-kebab", "snake case kebab"), ("ABC", "ABC"), ("getX9Y", "get X 9 Y")]
PACKAGES = [("PyPI", "Foo__Bar.baz", "foo-bar-baz"), ("npm", "@Scope/Name", "@scope/name"), ("Maven", "Org:Art", "Org:Art"), ("Go", "Github.com/X", "Github.com/X"), ("NuGet", "NewtonSoft", "newtonsoft")]
VECTORS = [("NLNNUHHH", 9.8), ("NLNNCHHH", 10.0), ("LHLRULNN", 2.2), ("NLNRCLLN", 6.1), ("PHHRUNNN", 0.0), ("ALLNCNHL", 7.6)]
DIGEST = "d41d8cd98f00b204e9800998ecf8427e"
RULES = [
    (DIGEST, "a/yarn.lock", "", None, 1, "hash_in_manifest"), (DIGEST, "a/b.py", "", "sha256", 1, "hash_in_manifest"), (DIGEST, "a/b.py", "", None, 1, None), ("123e4567-e89b-12d3-a456-426614174000", "a.py", "", None, 1, "uuid"),
    ("dGhlIHF1aWNrIGJyb3duIGZveA==", "a.py", "", None, 1, "base64_text"), ("xxxx", "a.py", "", None, 1, "placeholder_value"), ("${TOKEN}", "a.py", "", None, 1, "placeholder_value"), ("YOUR_API_KEY_HERE", "a.py", "", None, 1, "placeholder_value"),
    ("k9Qz81LmPw", "tests/a.py", "key = example", None, 1, "example_marker"), ("k9Qz81LmPw", "src/a.py", "key = example", None, 1, None), ("k9Qz81LmPw", "src/a.py", "", None, 21, "repeated_value"), ("k9Qz81LmPw", "src/a.py", "", None, 20, None),
]


@pytest.mark.parametrize(
    ("rows", "names", "result"),
    [
        (CHECKS, "kind string, value string", lambda: triage.number_valid(F.col("kind"), F.col("value"))),
        (PATHS, "p string", lambda: codes.repository_path(F.col("p"))),
        (WORDS, "n string", lambda: F.array_join(codes.sub_words(F.col("n")), " ")),
        (PACKAGES, "e string, n string", lambda: codes.package_name(F.col("e"), F.col("n"))),
        ([("2363", True), ("2364", False), ("123451", True), ("84736430954837284567892", True)], "n string", lambda: scalars.verhoeff_valid(F.col("n"))),
        (RULES, "value string, path string, line string, field string, times int", lambda: formats.secret_filter(*(F.col(c) for c in ("value", "path", "line", "field", "times")))),
    ],
)
def test_known_answers(spark, rows, names, result):
    got = spark.createDataFrame([(i, *r[:-1]) for i, r in enumerate(rows)], f"i int, {names}").select("i", result().alias("x"))
    assert [r.x for r in sorted(got.collect())] == [r[-1] for r in rows]


def test_scores(spark):
    rows = spark.createDataFrame([(i, *v) for i, (v, _) in enumerate(VECTORS)], "i int, av string, ac string, pr string, ui string, s string, c string, i2 string, a string")
    got = risk.cvss31_base(rows.withColumnRenamed("i", "k").withColumnRenamed("i2", "i")).select("k", "base_score").collect()
    assert [x for _, x in sorted(got)] == [s for _, s in VECTORS]


def test_ledgers_stop_and_resume(spark, tmp_path):
    rows, before = [], "0" * 64
    for n in range(1, 10):
        own = hashlib.sha256(f"b{n}".encode()).hexdigest()
        rows.append(("k", n, f"b{n}", n, f"2024-01-0{n} 00:00:00", before, own))
        before = own
    rows[6] = (*rows[6][:4], "2023-01-01 00:00:00", *rows[6][5:])
    shape = "key string, n int, body string, seq long, ts string, prev_hash string, entry_hash string"
    table = spark.createDataFrame(rows + [("j", 1, "x", 2, "2024-01-01 00:00:00", "0" * 64, hashlib.sha256(b"x").hexdigest())], shape).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    folder, seen = f"file://{tmp_path}", []
    for part in ("n <= 3", "n > 3 AND n <= 6", "n > 6"):
        table.where(part).write.mode("append").parquet(f"{folder}/in")
        found = ledgers.run_to_end(spark.readStream.schema(table.schema).parquet(f"{folder}/in"), "key", "n", f"{folder}/run")
        seen.append({r["key"]: tuple(r)[1:] for r in found.collect()})
    assert [s["k"] for s in seen] == [(3, True, None, None), (6, True, None, None), (9, False, 7, "time")]
    assert seen[-1]["j"] == (1, False, 2, "genesis")
    whole = triage.verified_chains(table, "key", "n").collect()
    assert {r["key"]: (r.entries, r.ok, r.first_bad, r.reason) for r in whole} == seen[-1]


def test_depths(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 4), (4, 5), (9, 1)], "a long, b long")
    got = graph.depths(edges, spark.createDataFrame([(1,), (1,)], "node long"))
    assert {r.node: r.depth for r in got.collect()} == {1: 0, 2: 1, 4: 1, 3: 2, 5: 2}
