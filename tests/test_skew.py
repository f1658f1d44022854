"""A third of the rows on one key: results stay those of plain SQL on the same tables."""

from __future__ import annotations

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from swathline.plans.views import TABLES
from tools.check_sql import compare

from .conftest import FOLDER

HOT = {
    "lineitem": "l_orderkey = CASE WHEN l_linenumber % 3 = 0 THEN 7 ELSE l_orderkey END",
    "orders": "o_custkey = CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey END",
    "events": "user_id = CASE WHEN event_id % 3 = 0 THEN 3 ELSE user_id END",
    "embeddings": "label = CASE WHEN vec_id % 3 = 0 THEN 1 ELSE label END",
    "customer": "c_nationkey = CASE WHEN c_custkey % 3 = 0 THEN 5 ELSE c_nationkey END",
    "supplier": "s_nationkey = CASE WHEN s_suppkey % 3 = 0 THEN 5 ELSE s_nationkey END",
}
NAMES = [
    "job_filter", "dataset_filter", "dataset_stats", "dataset_status", "user_dataset_stats", "latest_archive",
    "latest_failed_error", "product_missing", "product_summary", "product_dataset", "org_scope", "upload_outcome",
    "top1_product_run", "webhook_fanout", "manifest_group", "manifest_rebuild", "band_counts", "reference_band",
    "reconstruction_stats", "flight_strips", "strip_gain", "heading_groups", "image_pairs", "trajectory_stats",
    "ratio_match", "callback_fold", "running_status", "stage_durations", "stage_machine", "kpi_stage", "ttl_expiry",
    "dedupe_product", "gps_centroid", "grid_points_max", "voxel_downsample", "stream_callback_fold",
    "stream_stage_machine", "webhook_stream",
]


@pytest.fixture(scope="module")
def hot(tmp_path_factory):
    folder = tmp_path_factory.mktemp("hot")
    con = duckdb.connect()
    for t in TABLES:
        change = ""
        if t in HOT:
            col, expr = HOT[t].split(" = ", 1)
            change = f" REPLACE ({expr} AS {col})"
        con.execute(f"COPY (SELECT *{change} FROM '{FOLDER}/{t}.parquet') TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", NAMES)
def test_hot_key(spark, hot, name):
    folder, con = hot
    problem, _ = compare(queries()[name](spark, folder), con, oracle_sql()[name])
    assert problem is None, problem
