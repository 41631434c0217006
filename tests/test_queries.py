"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import pytest
from compare import connect, duck_rows, spark_rows
from conftest import TESTDATA

import __spark_entry__ as entry
from stakelens import registry

FOLDER = f"{TESTDATA}/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    got = spark_rows(df)
    if name in ORACLES:
        assert got == duck_rows(con, ORACLES[name])
        shape = con.execute(f"select * from ({ORACLES[name]}) q limit 0").description
        assert sorted(df.columns) == sorted(d[0] for d in shape)
    else:
        assert got


def test_only_the_model_lacks_a_twin():
    assert set(registry.QUERIES) - set(ORACLES) == {"churn_model_comparison"}
    assert set(ORACLES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
