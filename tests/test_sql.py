"""Every registered query against its SQL on the given tables."""

from __future__ import annotations

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from swathline.plans.views import TABLES
from tools.check_sql import compare

from .conftest import FOLDER

QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    if name not in SQL:
        assert df.count() > 0
        return
    problem, _ = compare(df, con, SQL[name])
    assert problem is None, problem


def test_entry(spark):
    assert entry(spark).count() > 0
