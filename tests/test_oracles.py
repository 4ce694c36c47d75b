"""Registered queries against DuckDB on the same tables.

All of them by default; ORACLES=some runs a part.
"""
import os

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
SOME = (
    "currency_prices", "mixed_birth_dates", "cleaned_register", "cleaned_ledger", "cleaning_report",
    "orphan_keys", "client_features", "label_codes", "numeric_summary", "correlation_matrix", "price_boxes",
    "welch_tests", "segment_profile", "segmented_clients", "segment_fingerprint", "scaled_log_standard",
    "davies_bouldin", "silhouette_by_cluster", "partition_agreement", "rule_grid", "key_figures",
    "capital_share_texts", "country_segment_mix", "client_explorer",
)


def chosen():
    return SOME if os.environ.get("ORACLES") == "some" else sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", chosen())
def test_query_matches_sql(spark, duck, name):
    df = E.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    cursor = duck.execute(E.oracle_sql()[name])
    found = [d[0] for d in cursor.description]
    assert sorted(found) == columns
    want = [tuple(r[found.index(c)] for c in columns) for r in cursor.fetchall()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == pytest.approx(y, abs=2e-6) if isinstance(x, float) else x == y for x, y in zip(a, b)), (a, b)


def test_entry(spark):
    assert E.entry(spark).count() == 4
