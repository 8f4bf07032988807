"""Every registered query with SQL gives the same rows in both engines; the others run and are not empty."""

from __future__ import annotations

import pytest

from agro_jobs.plans import catalogue
from tests.oracle import connect, rows

SLOW = {"stream_conversation"}


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows(spark, data, con, name):
    got, want = rows(catalogue.QUERIES[name](spark, data).toPandas()), rows(con.sql(catalogue.ORACLE_SQL[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) - SLOW))
def test_runs(spark, data, name):
    assert catalogue.QUERIES[name](spark, data).count() > 0


def test_stream_fold_equals_batch_fold(spark, data):
    batch = rows(catalogue.QUERIES["conversation_fold"](spark, data).toPandas())
    assert rows(catalogue.QUERIES["stream_conversation"](spark, data).toPandas()) == batch


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
