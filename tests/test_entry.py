"""The entry points, with and without the removable subpackage."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from kinsift.plans import catalog

TESTDATA = "/root/testdata/sf0.001"
TABLES = ("lineitem", "part", "documents", "benchmark", "labels", "conversations")


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    show = lambda v: "-" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[k]) for k in order) for r in rows)


def test_all_queries_have_sql_or_are_known_not_to():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
    assert set(catalog.queries()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 1


@pytest.mark.parametrize("name", ["clean_unified", "word_index", "minhash_signatures", "lsh_candidates", "brand_whole_word", "pair_similarity", "tmwm_fast", "clusters", "bootstrap_oob", "fair_auc", "pending_configs"])
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{TESTDATA}/{t}.parquet'")
    df = catalog.queries()[name](spark, TESTDATA)
    want = con.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert normal(df.collect(), df.columns) == normal(want.fetchall(), want.columns)
