"""Every query of the catalogue against its SQL on DuckDB, at the smallest size."""

from __future__ import annotations

import duckdb
import pytest

from tidemark.plans import analytics, catalogue, columns, detectors, evidence, posture, relations, review, security

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(rows):
    out = [tuple(round(float(v), 6) if isinstance(v, float) else v for v in r) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


#: Greedy folds and resampling have no SQL; tests/test_operators.py has their brute force.
NO_SQL = {"all_detectors", "bootstrap_ci", "document_findings"}


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    expected = duck.sql(catalogue.ORACLES[name])
    assert sorted(expected.columns) == columns
    assert normal(rows) == normal(expected.select(*[f'"{c}"' for c in columns]).fetchall())


def test_every_query_has_sql():
    assert all(m.query is catalogue.query for m in (analytics, columns, detectors, evidence, posture, relations, review, security))
    assert set(catalogue.QUERIES) - NO_SQL == set(catalogue.ORACLES)


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[:2] == ["doc_id", "lang"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
