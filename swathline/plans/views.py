"""Survey tables derived from the given tables, as SQL text that runs in Spark and in DuckDB.

``{name}`` stands for a table or another view.  Where the two dialects differ, a view has a text for
each.  ``{NTZ}`` is the zone-free timestamp literal keyword.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from swathline.functions import constants as K

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def case_list(expr: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {expr} {arms} END"


def seconds(expr: str) -> str:
    return f"INTERVAL '1' SECOND * ({expr})"


CELL_COLS = """capture, concat('c', cast(capture AS STRING)) AS raster_id,
  CASE b WHEN 0 THEN 'green' WHEN 1 THEN 'red' WHEN 2 THEN 'red_edge' ELSE 'nir' END AS band,
  cast(floor(pos / 8) AS INT) AS row, cast(pos % 8 AS INT) AS col,
  CASE WHEN (capture + pos) % 17 = 0 THEN NULL ELSE (cast(e AS DOUBLE) + 1) / 2 END AS value"""

VIEWS: dict[str, str | dict[str, str]] = {
    "cells": {
        "spark": f"SELECT {CELL_COLS} FROM (SELECT cast(floor(vec_id / 4) AS BIGINT) AS capture, "
                 "vec_id % 4 AS b, posexplode(embedding) AS (pos, e) FROM {embeddings})",
        "duckdb": f"SELECT {CELL_COLS} FROM (SELECT cast(floor(vec_id / 4) AS BIGINT) AS capture, "
                  "vec_id % 4 AS b, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS pos "
                  "FROM {embeddings})",
    },
    "points": """SELECT (l_partkey * 7919 + l_orderkey * 31) % 20000 AS x_cm,
        (l_suppkey * 104729 + l_orderkey * 17) % 20000 AS y_cm, l_extendedprice / 1000 AS z,
        cast(round(l_quantity * 5) AS INT) AS red, cast(round(l_discount * 2000) AS INT) AS green,
        cast(round(l_tax * 2500) AS INT) AS blue FROM {lineitem}""",
    "offsets9": "SELECT * FROM (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,0),(0,1),(1,-1),(1,0),(1,1)) AS t(dr, dc)",
    "dsm": """SELECT 'dsm' AS raster_id, 'dsm' AS band, row, col, max(z) AS value FROM (
        SELECT cast(floor(y_cm / 50) + dr AS INT) AS row, cast(floor(x_cm / 50) + dc AS INT) AS col,
          x_cm, y_cm, z FROM {points} CROSS JOIN {offsets9})
        WHERE row BETWEEN 0 AND 399 AND col BETWEEN 0 AND 399
          AND (x_cm - (col * 50 + 25)) * (x_cm - (col * 50 + 25))
            + (y_cm - (row * 50 + 25)) * (y_cm - (row * 50 + 25)) <= 2500
        GROUP BY row, col""",
    "offsets25": "SELECT a.v AS dr, b.v AS dc FROM (VALUES (-2),(-1),(0),(1),(2)) AS a(v) "
                 "CROSS JOIN (VALUES (-2),(-1),(0),(1),(2)) AS b(v)",
    "wide_dsm": """SELECT row, col, max(z) AS value FROM (
        SELECT cast(floor(y_cm / 50) + dr AS INT) AS row, cast(floor(x_cm / 50) + dc AS INT) AS col,
          x_cm, y_cm, z FROM {points} CROSS JOIN {offsets25})
        WHERE row BETWEEN 0 AND 399 AND col BETWEEN 0 AND 399
          AND (x_cm - (col * 50 + 25)) * (x_cm - (col * 50 + 25))
            + (y_cm - (row * 50 + 25)) * (y_cm - (row * 50 + 25)) <= 10000
        GROUP BY row, col""",
    "dense": """SELECT g.row, g.col, value FROM (SELECT cast(floor(id / 400) AS INT) AS row,
        cast(id % 400 AS INT) AS col FROM range(160000) AS t(id)) g
        LEFT JOIN {dsm} d ON g.row = d.row AND g.col = d.col""",
    "captures": """SELECT event_id AS capture_id, user_id AS flight, ts,
        41 + (event_id % 5) * 18e-5 + ((event_id * 7) % 11) * 2e-7 AS lat,
        -37e-1 + ((event_id * 31) % 97) * 3e-5 AS lon,
        1e2 + ((event_id * 3) % 40) / 4e0 AS alt,
        ((event_id * 17) % 3600) / 1e1 AS yaw,
        event_id % 5 AS true_strip, value AS band_mean,
        concat('DJI_', lpad(cast(user_id AS STRING), 6, '0'), '_', lpad(cast(event_id % 10000 AS STRING), 4, '0'),
          '_', CASE event_id % 5 WHEN 0 THEN 'D' WHEN 1 THEN 'MS_G' WHEN 2 THEN 'MS_R' WHEN 3 THEN 'MS_RE'
          ELSE 'MS_NIR' END, CASE WHEN event_id % 5 = 0 THEN '.JPG' ELSE '.TIF' END) AS file_name,
        event_type FROM {events}""",
    "datasets": """SELECT c_custkey AS dataset_id, c_nationkey AS org_id, c_name AS name,
        concat('survey ', c_mktsegment, ' ', cast(c_custkey % 97 AS STRING)) AS notes, c_mktsegment AS platform,
        c_custkey % 50 AS user_id,
        {NTZ} '1996-01-01 00:00:00' + INTERVAL '1' HOUR * (c_custkey * 29 % 40000) AS created_at,
        {NTZ} '1996-02-01 00:00:00' + INTERVAL '1' HOUR * (c_custkey * 31 % 40000) AS updated_at,
        {NTZ} '1995-12-01 00:00:00' + INTERVAL '1' HOUR * (c_custkey * 37 % 40000) AS capture_start
        FROM {customer}""",
    "orgs": """SELECT n_nationkey AS org_id, n_name AS name, n_regionkey AS user_id,
        CASE n_nationkey % 3 WHEN 0 THEN 'farm' WHEN 1 THEN 'lab' ELSE 'agency' END AS kind FROM {nation}""",
    "jobs": f"""SELECT job_id, dataset_id, status, stage, progress, resolution_gsd, analysis_mode, retry_count,
        can_retry, created_at, started_at, updated_at,
        CASE WHEN status IN ('completed', 'failed') AND job_id % 11 <> 0 AND started_at IS NOT NULL
          THEN started_at + {seconds("job_id * 53 % 86400")} END AS completed_at
      FROM (SELECT o_orderkey AS job_id, o_custkey AS dataset_id,
        CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'failed' ELSE 'completed' END
          WHEN 'O' THEN {case_list("o_orderkey % 3", ["pending", "queued", "processing"])}
          ELSE {case_list("o_orderkey % 3", ["cancelled", "processing", "completed"])} END AS status,
        {case_list("o_orderkey % 10", K.STAGES)} AS stage,
        cast(o_orderkey % 101 AS INT) AS progress,
        CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE cast(o_orderkey % 13 - 1 AS DOUBLE) END AS resolution_gsd,
        {case_list("o_orderkey % 7", ["fast", "full", "fast", "full", "fast", "draft"])} AS analysis_mode,
        cast(o_orderkey % 5 AS INT) AS retry_count, o_orderkey % 7 <> 0 AS can_retry,
        o_orderdate AS created_at,
        CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderdate + {seconds("o_orderkey * 37 % 3600")} END AS started_at,
        o_orderdate + {seconds("o_orderkey * 71 % 172800")} AS updated_at FROM {{orders}})""",
    "images": """SELECT l_orderkey * 8 + l_linenumber AS image_id, o_custkey AS dataset_id,
        CASE l_returnflag WHEN 'A' THEN 'ARCHIVE' WHEN 'N' THEN 'IMAGE' ELSE NULL END AS file_type,
        CASE WHEN l_partkey % 19 = 0 THEN 'FAILED' WHEN l_partkey % 7 = 0 THEN 'PROCESSING'
          WHEN l_linestatus = 'O' AND l_linenumber > 5 THEN 'PENDING' ELSE 'COMPLETED' END AS status,
        CASE l_linenumber % 4 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/tiff' WHEN 2 THEN 'application/zip'
          ELSE NULL END AS content_type,
        cast(round(l_extendedprice * 100) AS BIGINT) AS file_size, o_custkey % 50 AS user_id, l_suppkey AS batch_id,
        CASE WHEN l_partkey % 19 = 0 AND l_suppkey % 5 <> 0 THEN concat('E', cast(l_suppkey AS STRING)) END
          AS error_message,
        o_orderdate AS created_at, l_shipdate AS updated_at
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "statuses": """SELECT * FROM (VALUES ('PENDING', 'Waiting'), ('PROCESSING', 'In progress'),
        ('COMPLETED', 'Done'), ('FAILED', 'Error')) AS t(status, status_label)""",
    "products": f"""SELECT l_orderkey AS job_id, o_custkey AS dataset_id,
        {case_list("l_partkey % 24", K.PRODUCT_TYPES)} AS type, l_shipdate AS created_at,
        l_quantity / 10 AS resolution_cm, l_linenumber AS seq, l_suppkey AS revision,
        CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE concat('s3/', cast(l_suppkey AS STRING)) END AS uri
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey""",
    "callbacks": f"""SELECT event_id, user_id AS job_id, ts,
        CASE event_type WHEN 'view' THEN 'progress' WHEN 'click' THEN 'progress' WHEN 'purchase' THEN 'complete'
          WHEN 'error' THEN 'error' ELSE CASE WHEN event_id % 2 = 0 THEN 'upload_status' ELSE 'ping' END END AS type,
        cast(floor(value) AS INT) % 101 AS progress,
        {case_list("event_id % 11", K.STAGES)} AS current_stage,
        CASE WHEN event_id % 4 = 0 THEN 100 ELSE 50 END AS stage_progress,
        concat('failure ', cast(event_id % 13 AS STRING)) AS error_message,
        CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'dsm' ELSE 'orthomosaic,ndvi' END AS failed_types
        FROM {{events}}""",
    "stage_events": f"""SELECT event_id, user_id AS job_id, ts,
        {case_list("event_id % 5", ["radiometric_calibration", "sfm", "orthomosaic", "uploading", "publishing"])}
          AS stage,
        CASE event_type WHEN 'view' THEN 'start' WHEN 'click' THEN 'start' WHEN 'error' THEN 'fail'
          ELSE 'complete' END AS action FROM {{events}}""",
    "hooks": """SELECT s_suppkey AS hook_id, s_nationkey AS org_id, concat('u', cast(s_suppkey AS STRING)) AS url,
        s_suppkey % 4 <> 0 AS active,
        CASE s_suppkey % 3 WHEN 0 THEN 'view,click' WHEN 1 THEN 'error' ELSE 'purchase,signup,error' END AS event_list
        FROM {supplier}""",
    "gcps": """SELECT cast(s_suppkey AS STRING) AS id, s_acctbal * 10 AS x, s_suppkey * 7 + s_acctbal AS y,
        CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_acctbal / 100 END AS z FROM {supplier}""",
    "estimates": """SELECT id, x + (k % 7 - 3) / 1e2 AS x, y + (k % 5 - 2) / 1e2 AS y,
        CASE WHEN k % 3 = 0 THEN NULL ELSE z + (k % 9 - 4) / 5e1 END AS z
        FROM (SELECT id, x, y, z, cast(id AS BIGINT) AS k FROM {gcps}) WHERE k % 10 <> 9""",
    "runs": """SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'calibration' WHEN '2-HIGH' THEN 'sfm'
          WHEN '3-MEDIUM' THEN 'orthomosaic' WHEN '4-NOT SPECIFIED' THEN 'indices' ELSE 'upload' END AS stage,
        CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2
          WHEN '4-NOT SPECIFIED' THEN 3 ELSE 4 END AS stage_order,
        o_orderkey AS run_index, o_orderstatus <> 'P' AS success, o_totalprice / 1000 AS elapsed_seconds,
        o_orderkey % 200 AS image_count, cast(floor(o_totalprice) AS BIGINT) * 1000 AS output_bytes,
        CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE cast(o_orderkey % 4 AS BIGINT) END AS gpu_count,
        cast(o_orderkey AS DOUBLE) AS submit_time,
        CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderkey + (o_orderkey % 60) / 4e0 END AS start_time
        FROM {orders}""",
    "validations": """SELECT CASE c_custkey % 6 WHEN 0 THEN 'radiometric' WHEN 1 THEN 'vegetation' WHEN 2 THEN 'visual'
        WHEN 3 THEN 'performance' WHEN 4 THEN 'checkpoint' ELSE 'spatial' END AS validator,
        c_custkey % 6 < 4 OR c_custkey % 5 <> 0 AS passed, c_nationkey AS org_id FROM {customer}""",
    "files": """SELECT page_id AS file_id, concat(CASE page_id % 9 WHEN 0 THEN '__MACOSX/' WHEN 1 THEN '../up/'
          WHEN 2 THEN './' ELSE '' END, 'set', cast(page_id % 20 AS STRING), '/',
          CASE page_id % 7 WHEN 0 THEN 'rededge' WHEN 1 THEN 'msp4c' ELSE 'flight' END, '/',
          CASE WHEN page_id % 13 = 0 THEN '.' ELSE '' END,
          CASE page_id % 6 WHEN 0 THEN 'GCPs' WHEN 1 THEN 'site_dsm' ELSE concat('IMG_', cast(page_id AS STRING)) END,
          CASE page_id % 6 WHEN 0 THEN '.csv' WHEN 1 THEN '.tif' WHEN 2 THEN '.JPG' WHEN 3 THEN '.dng'
          WHEN 4 THEN '.MRK' ELSE '.exe' END) AS path, length(html) AS length, html FROM {pages}""",
    "poses": """SELECT capture_id AS image_id, flight AS scene, cast(capture_id AS BIGINT) AS ordinal,
        cos(yaw / 36e1) AS qw, 0e0 AS qx, 0e0 AS qy, sin(yaw / 36e1) AS qz,
        (lat - 41) * 1e5 AS tx, (lon + 37e-1) * 1e5 AS ty, alt / 10 AS tz, lat, lon, alt FROM {captures}""",
    "camera_meta": """SELECT capture_id, lat, lon, 8 AS width, 6 AS height,
        CASE WHEN capture_id % 4 = 0 THEN -(capture_id % 50) * 1e0 END AS relative_altitude,
        CASE WHEN capture_id % 3 = 0 THEN 2e2 + capture_id % 60 END AS absolute_altitude,
        CASE WHEN capture_id % 5 <> 0 THEN 19e1 + capture_id % 70 END AS exif_altitude,
        CASE WHEN capture_id % 11 = 0 THEN 1 ELSE 0 END AS exif_altitude_ref,
        CASE WHEN capture_id % 6 = 0 THEN (capture_id % 13) * 1e0 END AS focal_px,
        CASE WHEN capture_id % 7 = 0 THEN 45e-1 END AS focal_mm,
        CASE WHEN capture_id % 14 = 0 THEN 2e1 END AS plane_resolution,
        CASE WHEN capture_id % 28 = 0 THEN 3 END AS plane_unit,
        CASE WHEN capture_id % 5 = 0 THEN 24e0 END AS focal_35mm,
        CASE capture_id % 9 WHEN 0 THEN 'M3M' WHEN 1 THEN 'P4M' WHEN 2 THEN 'X9' END AS drone_model,
        CASE WHEN capture_id % 2 = 0 THEN yaw END AS flight_yaw,
        CASE WHEN capture_id % 3 = 0 THEN yaw + 1 END AS gimbal_yaw FROM {captures}""",
    "scenes": """SELECT raster_id, 8 AS width, 8 AS height, g.c * 1e0 AS gt0, cos(a) * 7e-1 AS gt1, -sin(a) * 7e-1 AS gt2,
        g.r * 1e0 AS gt3, sin(a) * 7e-1 AS gt4, cos(a) * 7e-1 AS gt5 FROM (SELECT DISTINCT raster_id, capture * 37 % 90 AS c,
        capture * 53 % 90 AS r, (capture % 60) / 1e1 AS a FROM {cells}) g""",
    "counts": "SELECT raster_id, band, row, col, capture, floor(coalesce(value, 0) * 65535) AS value FROM {cells}",
    "sensor_meta": """SELECT raster_id, band, capture, 8 AS width, 8 AS height, 1 + (capture % 4) / 2e0 AS sensor_gain,
        5e2 + capture % 9 * 100 AS exposure_time_us, 32e2 AS black_level, 9e-1 + (capture % 3) / 1e1 AS sensor_gain_adjustment,
        CASE WHEN capture % 23 = 7 THEN NULL ELSE 2e3 + capture % 500 END AS irradiance, 11e-1 AS irradiance_exposure,
        1e0 AS irradiance_gain, 16 AS bit_depth, CASE WHEN capture % 2 = 0 THEN 41e-1 END AS centre_x,
        CASE WHEN capture % 2 = 0 THEN 39e-1 END AS centre_y FROM (SELECT DISTINCT raster_id, band, capture FROM {cells})""",
    "coarse": """SELECT cast(floor(y_cm / 400) AS INT) AS row, cast(floor(x_cm / 400) AS INT) AS col, max(z) AS z
        FROM {points} GROUP BY 1, 2""",
    "site_poses": """SELECT image_id, 0e0 AS qw, a AS qx, b AS qy, 0e0 AS qz, -((1 - 2 * b * b) * cx + 2 * a * b * cy) AS tx,
        -(2 * a * b * cx + (1 - 2 * a * a) * cy) AS ty, cz AS tz, 1 - 2 * b * b AS r00, 2 * a * b AS r01,
        1 - 2 * a * a AS r11, cx, cy, cz FROM (SELECT s_suppkey AS image_id, cos(s_suppkey % 31 / 1e1) AS a, sin(s_suppkey % 31 / 1e1) AS b,
        (s_suppkey * 7919 % 197) * 1e0 AS cx, (s_suppkey * 104729 % 199) * 1e0 AS cy, 13e1 + s_suppkey % 20 AS cz FROM {supplier})""",
    "mark_lines": """SELECT line_no, CASE k WHEN 0 THEN concat(n, ' 381207.125000 [2290] 12,N 7,E -31,V ', la, ',Lat ', lo, ',Lon ', al, ',Ellh')
        WHEN 1 THEN concat(n, ' 2024/07/19 08:43:15 ', la, ' ', lo, ' ', al) WHEN 2 THEN concat('  ', n, ' 2024/07/19T08:43:15  ', la, ' ', lo, ' ', al, ' x')
        WHEN 3 THEN concat('# ', n, ' 1 ', la, ' ', lo, ' ', al) WHEN 4 THEN '   ' WHEN 5 THEN concat(n, ' t ', la, ' bad ', al)
        ELSE concat('; ', la) END AS value, k, n, cast(la AS DOUBLE) AS lat, cast(lo AS DOUBLE) AS lon, cast(al AS DOUBLE) AS alt
        FROM (SELECT event_id AS line_no, event_id % 7 AS k, cast(event_id * 13 % 3000 + 1 AS STRING) AS n,
        concat('41.', lpad(cast(event_id AS STRING), 8, '0')) AS la, concat('23.', lpad(cast(event_id * 3 AS STRING), 8, '0')) AS lo,
        concat(cast(event_id % 100 AS STRING), '.5') AS al FROM {events})""",
    "pose_lines": """SELECT event_id AS line_no, CASE WHEN event_id % 10 = 0 THEN '# image qw qx qy qz tx ty tz' WHEN event_id % 10 = 1 THEN '1 2 3'
        ELSE concat(cast(event_id AS STRING), ' img', cast(event_id AS STRING), '.jpg 1.0 0.0 0.5 -0.25  ', cast(event_id % 100 AS STRING), '.5 ',
        cast(event_id % 7 AS STRING), ' -', cast(event_id % 9 AS STRING), '.25 camera') END AS value, event_id FROM {events}""",
    "control": """SELECT s_suppkey AS line_no, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE cast(s_suppkey % 60 AS STRING) END AS id,
        CASE WHEN s_suppkey % 8 = 0 THEN NULL ELSE concat('p', cast(s_suppkey % 30 AS STRING)) END AS point_id, s_name AS name,
        cast(s_acctbal AS STRING) AS x, cast(s_suppkey AS STRING) AS y, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '7.5' END AS z FROM {supplier}""",
    "spectra": """SELECT o_orderkey AS line_no, cast(o_orderkey AS STRING) AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'bad' ELSE cast(o_orderkey % 97 / 1e2 AS STRING) END AS Red,
        CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE cast(o_orderkey % 89 / 1e2 AS STRING) END AS Green, cast(o_orderkey % 83 / 1e2 AS STRING) AS NIR FROM {orders}""",
    "measured": """SELECT o_orderkey AS line_no, cast(o_orderkey AS STRING) AS id, CASE WHEN o_orderkey % 6 = 0 THEN 'n/a' ELSE cast((o_orderkey % 97 + o_orderkey % 3) / 1e2 AS STRING) END AS Red,
        cast((o_orderkey % 89 - o_orderkey % 4) / 1e2 AS STRING) AS Green, cast(o_orderkey % 41 / 1e2 AS STRING) AS NIR FROM {orders}""",
    "stat_docs": """SELECT o_orderkey AS doc_id, replace(replace(concat('<"outputs": <"orthomosaic.tif": <"width": ',
        cast(o_orderkey % 900 AS STRING), ', "height": 80, "crs": "EPSG:32630", "size_mb": 1.5, "bands": ', cast(o_orderkey % 5 AS STRING),
        ', "geotransform": [0, ', cast(o_orderkey % 40 / 1e3 AS STRING), ', 0, 0, 0, -1]>, "dsm.tif": <"width": 7>>>'),
        '<', chr(123)), '>', chr(125)) AS doc FROM {orders}""",
    "classified": """SELECT dataset_id, concat('set/', lpad(cast(image_id AS STRING), 9, '0'), '_', cast(batch_id AS STRING), '_', cast(file_size AS STRING)) AS file_path,
        CASE WHEN dataset_id % 4 = 0 THEN 'rgb' ELSE CASE image_id % 4 WHEN 0 THEN 'rgb' WHEN 1 THEN 'red' WHEN 2 THEN 'nir' ELSE 'unknown' END END AS band,
        CASE batch_id % 3 WHEN 0 THEN 'dji' WHEN 1 THEN 'micasense' ELSE 'unknown' END AS manufacturer, CASE batch_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'M3M' ELSE 'Altum' END AS drone_model,
        CASE WHEN status = 'FAILED' THEN 'unreadable' END AS error, batch_id AS folder_no,
        CASE status WHEN 'FAILED' THEN 'failed' WHEN 'PROCESSING' THEN 'calibrated' ELSE 'reflectance' END AS state FROM {images}""",
    "image_names": """SELECT l_orderkey AS k, l_linenumber AS ln, l_partkey AS pk, concat('DJI_', cast(l_orderkey AS STRING), CASE l_partkey % 12 WHEN 0 THEN '_D.JPG' WHEN 1 THEN '_ms_g.TIF' WHEN 2 THEN '_MS_NIR.TIF'
        WHEN 3 THEN '_NIR.tif' WHEN 4 THEN '_RGB.jpg' WHEN 5 THEN '_T.jpg' WHEN 6 THEN '_TIR.jpg' WHEN 7 THEN '_MS_RE.TIF' WHEN 8 THEN '_MS_R.TIF' ELSE '.png' END) AS file_name,
        CASE l_suppkey % 6 WHEN 0 THEN 'Red Edge' WHEN 1 THEN 'Panchro' WHEN 2 THEN ' near-infrared ' WHEN 3 THEN 'odd' ELSE NULL END AS band_name,
        CASE l_partkey % 5 WHEN 0 THEN 'DJI' WHEN 1 THEN 'MicaSense' WHEN 2 THEN 'Parrot' ELSE NULL END AS make, CASE l_partkey % 3 WHEN 0 THEN 'RedEdge-M' END AS model,
        cast(NULL AS STRING) AS software, CASE l_suppkey % 7 WHEN 0 THEN 'DJI Mavic 3M' WHEN 1 THEN ' Altum-PT ' WHEN 2 THEN 'P4 RTK' WHEN 3 THEN 'Sequoia' END AS drone_model,
        CASE l_suppkey % 4 WHEN 0 THEN 'RGB' WHEN 1 THEN 'L' END AS colour_mode FROM {lineitem}""",
    "observations": """SELECT l_partkey AS point_id, l_orderkey AS image_id, l_discount * 10 AS error FROM {lineitem}""",
}

_NAME = re.compile(r"\{([a-z][a-z_0-9]*)\}")


def text_of(name: str, dialect: str) -> str:
    body = VIEWS[name]
    text = body[dialect] if isinstance(body, dict) else body
    return text.replace("{NTZ}", "TIMESTAMP_NTZ" if dialect == "spark" else "TIMESTAMP")


def parents(text: str) -> list[str]:
    return list(dict.fromkeys(n for n in _NAME.findall(text)))


def duckdb_sql(query: str) -> str:
    """Prefix a query that uses ``{view}`` names with the views it needs."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in parents(text):
            if name in VIEWS and name not in order:
                visit(text_of(name, "duckdb"))
                order.append(name)

    visit(query)
    plain = lambda t: _NAME.sub(lambda m: m.group(1), t)
    ctes = [f"{n} AS MATERIALIZED ({plain(text_of(n, 'duckdb'))})" for n in order]
    body = plain(query).strip()
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {', '.join(ctes)}, {body[5:]}"
    return f"WITH {', '.join(ctes)} {body}"


class Tables:
    """The given tables and the views on them, as DataFrames built on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._known: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in TABLES and name not in VIEWS):
            raise AttributeError(name)
        if name not in self._known:
            if name in TABLES:
                df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                text = text_of(name, "spark")
                df = self.spark.sql(text, **{p: getattr(self, p) for p in parents(text)})
            self._known[name] = df
        return self._known[name]
