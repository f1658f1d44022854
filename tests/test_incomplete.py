"""Captures that lack bands, and exposure numbers that begin anew: queries stay equal to their SQL."""

from __future__ import annotations

import os

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from swathline.plans.views import TABLES
from tools.check_sql import compare

from .conftest import FOLDER


@pytest.fixture(scope="module", params=[1, 2, 3])
def incomplete(request, tmp_path_factory):
    """The given tables; the last capture has 1, 2 or 3 of its four bands, and events go on past number 10,000."""
    folder = tmp_path_factory.mktemp("incomplete")
    con = duckdb.connect()
    for t in TABLES:
        os.symlink(f"{FOLDER}/{t}.parquet", f"{folder}/{t}.parquet")
    change = {
        "embeddings": f"SELECT * FROM '{FOLDER}/embeddings.parquet' WHERE vec_id < 36 + {request.param}",
        "events": f"SELECT * REPLACE (event_id + k * 10000 AS event_id) FROM '{FOLDER}/events.parquet', range(3) AS t(k)",
    }
    for t, text in change.items():
        os.unlink(f"{folder}/{t}.parquet")
        con.execute(f"COPY ({text}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["band_register", "band_register_search", "capture_pair", "index_ndre", "index_ndvi", "visual_color"])
def test_query(spark, incomplete, name):
    folder, con = incomplete
    problem, _ = compare(queries()[name](spark, folder), con, oracle_sql()[name])
    assert problem is None, problem
