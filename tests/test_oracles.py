"""Every registered query against its DuckDB oracle on the smallest tables."""
import pytest

import os, sys
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import __spark_entry__ as E
from precis.plans import catalog
from conftest import SF_SMALL
from oracle_check import duck_connect, run_one

SLOW = {"textrank_summaries"}


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF_SMALL)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - SLOW))
def test_query_matches_oracle(spark, con, name):
    r = run_one(spark, con, name, E.queries()[name], E.oracle_sql().get(name), SF_SMALL)
    assert r["status"] in ("match", "rows-only"), r


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["lang", "n_docs", "rouge1_p", "rouge1_r", "rouge1_f"]
    assert df.count() > 0
