"""Queries over jobs, products, datasets and uploads."""

from __future__ import annotations

from pyspark.sql import functions as F

from swathline.functions import constants as K
from swathline.functions.scalars import rounded as r6
from swathline.operators import aggregates as A
from swathline.operators import filters as O
from swathline.operators import ordering as S
from swathline.operators import relations as R
from swathline.plans.registry import query
from swathline.plans.views import Tables

AS_OF_TEXT = "1999-06-15 12:00:00"


def as_of():
    return F.lit(AS_OF_TEXT).cast("timestamp_ntz")


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


JOB_COLS = ["job_id", "dataset_id", "dataset_name", "status", "stage", "progress", "created_at"]


@query("job_filter", """SELECT job_id, j.dataset_id, name AS dataset_name, status, stage, progress, j.created_at
  FROM {jobs} j JOIN {datasets} d ON j.dataset_id = d.dataset_id WHERE org_id = 7
  AND status IN ('completed', 'failed') AND progress BETWEEN 10 AND 90
  AND j.created_at >= TIMESTAMP '1996-01-01' AND (contains(lower(name), '1') OR contains(cast(job_id AS STRING), '1'))""")
def _(t: Tables):
    return O.job_filter(t.jobs, t.datasets, org=7, status="completed, failed", progress_min="10", progress_max=90,
                        after="1996-01-01T00:00:00Z", before="not a date", search="1").select(*JOB_COLS)


@query("product_filter", """SELECT p.* FROM {products} p WHERE dataset_id IN (SELECT dataset_id FROM {datasets}
  WHERE org_id = 3) AND type = 'ndvi' AND created_at <= TIMESTAMP '2000-01-01 00:00:00'""")
def _(t: Tables):
    return O.product_filter(t.products, t.datasets, org=3, type="ndvi", before="2000-01-01T00:00:00Z")


STATUS_SQL = """SELECT dataset_id, count(*) AS image_count, cast(sum(file_size) AS BIGINT) AS total_size,
  count(*) FILTER (status = 'PENDING') AS pending_count, count(*) FILTER (status = 'PROCESSING') AS processing_count,
  count(*) FILTER (status = 'COMPLETED') AS completed_count, count(*) FILTER (status = 'FAILED') AS failed_count
  FROM {images} GROUP BY dataset_id"""
DATASET_STATUS_SQL = f"""SELECT d.dataset_id, coalesce(image_count, 0) AS image_count, coalesce(total_size, 0) AS total_size,
  coalesce(pending_count, 0) AS pending_count, coalesce(processing_count, 0) AS processing_count,
  coalesce(completed_count, 0) AS completed_count, coalesce(failed_count, 0) AS failed_count,
  CASE WHEN failed_count > 0 THEN 'HAS_ERROR' WHEN processing_count > 0 THEN 'PROCESSING'
    WHEN image_count = completed_count AND completed_count > 0 THEN 'COMPLETED' ELSE 'PENDING' END AS status
  FROM {{datasets}} d LEFT JOIN ({STATUS_SQL}) c ON d.dataset_id = c.dataset_id"""
STATUS_COLS = ["dataset_id", "image_count", "total_size", "pending_count", "processing_count", "completed_count",
               "failed_count", "status"]


@query("dataset_status", DATASET_STATUS_SQL)
def _(t: Tables):
    return A.dataset_status(t.datasets, t.images).select(*STATUS_COLS)


@query("dataset_filter", f"""SELECT s.* FROM ({DATASET_STATUS_SQL}) s JOIN {{datasets}} d ON s.dataset_id = d.dataset_id
  WHERE org_id < 100 AND org_id = 5 AND (contains(lower(name), '0') OR contains(lower(notes), 'survey'))
  AND (contains(lower(platform), 'build') OR contains(lower(platform), 'house') OR contains(lower(platform), 'mach'))
  AND created_at >= TIMESTAMP '1996-03-01' AND capture_start <= TIMESTAMP '2000-01-01'
  AND status IN ('HAS_ERROR', 'PENDING', 'PROCESSING')""")
def _(t: Tables):
    return O.dataset_filter(
            t.datasets, t.images, org=5, search="survey", platform="BUILD, house,Mach",
            status="has_error,pending,processing", created=("1996-03-01T00:00:00Z", None),
            captured=(None, "2000-01-01T00:00:00Z")).select(*STATUS_COLS)


@query("upload_filter", "SELECT image_id, dataset_id, status, file_size, created_at FROM {images} "
       "WHERE user_id = 11 AND file_type = 'ARCHIVE' AND batch_id = 5")
def _(t: Tables):
    return O.upload_filter(t.images, user=11, batch=5, file_type="ARCHIVE").select(
        "image_id", "dataset_id", "status", "file_size", "created_at")


@query("org_list", "SELECT org_id, name, kind FROM {orgs} WHERE user_id = 1 AND kind = 'lab'")
def _(t: Tables):
    return O.org_list(t.orgs, user=1, equals={"kind": "lab"}, order_by="-name").select("org_id", "name", "kind")


CATEGORY_SQL = "CASE " + " ".join(f"WHEN type IN ({quoted(v)}) THEN '{c}'" for c, v in K.PRODUCT_CATEGORIES.items()) \
    + " ELSE 'Other' END"
DISPLAY_SQL = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.PRODUCT_LABELS.items()) + " END"


@query("product_category", f"SELECT job_id, type, seq, {CATEGORY_SQL} AS category FROM {{products}}")
def _(t: Tables):
    return O.product_category(t.products).select("job_id", "type", "seq", "category")


@query("product_display", f"SELECT job_id, type, seq, {DISPLAY_SQL} AS type_display FROM {{products}}")
def _(t: Tables):
    return O.product_display(t.products).select("job_id", "type", "seq", "type_display")


@query("job_duration", """SELECT job_id, CASE WHEN status IN ('completed', 'failed') THEN
  date_diff('second', coalesce(started_at, created_at), coalesce(completed_at, updated_at)) END AS duration_seconds
  FROM {jobs}""")
def _(t: Tables):
    return O.job_duration(t.jobs).select("job_id", "duration_seconds")


@query("job_duration_detail", """SELECT job_id, s AS duration_seconds, concat(cast(floor(s / 3600e0) AS BIGINT), 'h ',
  cast(floor(((s % 3600 + 3600) % 3600) / 60e0) AS BIGINT), 'm ', (s % 60 + 60) % 60, 's') AS duration_text FROM (SELECT job_id,
  date_diff('second', coalesce(started_at, created_at), coalesce(CASE WHEN status IN ('completed', 'failed')
  THEN completed_at END, updated_at)) AS s FROM {jobs})""")
def _(t: Tables):
    return O.job_duration(t.jobs, detail=True).select("job_id", "duration_seconds", "duration_text")


@query("retry_eligible", """SELECT job_id, ok AS retry_ok, CASE WHEN ok AND stage NOT IN ('queued', 'completed') THEN stage END
  AS resume_stage FROM (SELECT job_id, stage, status IN ('failed', 'cancelled') AND can_retry AND retry_count < 3 AS ok
  FROM {jobs})""")
def _(t: Tables):
    return O.retry_eligible(t.jobs).select("job_id", "retry_ok", "resume_stage")


@query("cancel_eligible", "SELECT job_id, status FROM {jobs} WHERE status NOT IN ('completed', 'failed', 'cancelled')")
def _(t: Tables):
    return O.cancel_eligible(t.jobs).select("job_id", "status")


@query("delete_eligible", """SELECT dataset_id, name FROM {datasets} WHERE dataset_id NOT IN
  (SELECT dataset_id FROM {jobs} WHERE status IN ('pending', 'processing'))""")
def _(t: Tables):
    return O.delete_eligible(t.datasets, t.jobs).select("dataset_id", "name")


@query("delete_eligible_jobs", "SELECT job_id FROM {jobs} WHERE status <> 'processing'")
def _(t: Tables):
    return O.delete_eligible_jobs(t.jobs).select("job_id")


@query("job_validate", """SELECT job_id, CASE WHEN NOT coalesce(resolution_gsd > 0, false) THEN 'resolution'
  WHEN NOT coalesce(analysis_mode IN ('fast', 'full'), false) THEN 'mode'
  WHEN j.dataset_id NOT IN (SELECT dataset_id FROM {datasets} WHERE org_id <> 4) THEN 'dataset' ELSE 'accepted' END AS outcome
  FROM {jobs} j""")
def _(t: Tables):
    ok, bad = O.job_validate(t.jobs, t.datasets.where("org_id <> 4"))
    return ok.select("job_id", F.lit("accepted").alias("outcome")).unionByName(
        bad.select("job_id", F.col("reason").alias("outcome")))


@query("stage_progress", """SELECT job_id, stage, CASE stage WHEN 'radiometric_calibration' THEN 5e0 WHEN 'sfm' THEN 15e0
  WHEN 'orthomosaic' THEN 60e0 WHEN 'uploading' THEN 90e0 WHEN 'publishing' THEN 95e0 WHEN 'completed' THEN 100e0
  ELSE 0e0 END AS stage_percent, CASE stage WHEN 'pending' THEN 'queued' WHEN 'queued' THEN 'sfm' WHEN 'sfm' THEN
  'orthomosaic' WHEN 'orthomosaic' THEN 'uploading' WHEN 'uploading' THEN CASE WHEN job_id % 2 = 0 THEN 'completed'
  ELSE 'publishing' END WHEN 'publishing' THEN 'completed' END AS next_stage FROM {jobs}""")
def _(t: Tables):
    jobs = t.jobs.withColumn("skipped", F.when(F.col("job_id") % 2 == 0, F.array(F.lit("publishing")))
                             .otherwise(F.array().cast("array<string>")))
    return O.stage_progress(jobs, skip_calibration=True).select("job_id", "stage", "stage_percent", "next_stage")


@query("gsd_settings", """SELECT job_id, CASE WHEN g > 0 THEN cast(greatest(640, least(8192, floor(5280 * (25e-1 / g)))) AS BIGINT)
  ELSE 5280 END AS max_image_size, CASE WHEN resolution_gsd > 0 THEN resolution_gsd / 100 END AS ortho_resolution_m
  FROM (SELECT job_id, resolution_gsd, CASE WHEN analysis_mode = 'fast' THEN resolution_gsd * 2 ELSE resolution_gsd END AS g
  FROM {jobs})""")
def _(t: Tables):
    return O.gsd_settings(t.jobs).select("job_id", "max_image_size", "ortho_resolution_m")


@query("downsample_factor", """SELECT k, f AS factor, cast(floor(5280 * f) AS BIGINT) AS new_width,
  cast(floor(3956 * f) AS BIGINT) AS new_height FROM (SELECT k, CASE WHEN tg <= cg THEN 1e0 ELSE
  greatest(1e-1, least(1e0, cg / tg)) END AS f FROM (SELECT l_orderkey * 8 + l_linenumber AS k, l_quantity / 4 AS cg,
  (l_suppkey % 97 + 1) / 2e0 AS tg FROM {lineitem}))""")
def _(t: Tables):
    df = t.lineitem.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"),
                           (F.col("l_quantity") / 4).alias("current_gsd"),
                           ((F.col("l_suppkey") % 97 + 1) / 2.0).alias("target_gsd"),
                           F.lit(5280).alias("width"), F.lit(3956).alias("height"))
    return O.downsample_factor(df).select("k", "factor", "new_width", "new_height")


@query("expected_product_flags", f"""SELECT p.job_id, seq, type, coalesce(status IN ('pending', 'queued', 'processing'), false)
  AS job_active, type IN ({quoted(K.MULTISPECTRAL_PRODUCTS)}) AS is_multispectral,
  type NOT IN ({quoted(K.DOWNLOAD_ONLY_PRODUCTS)}) AS is_viewable FROM {{products}} p LEFT JOIN {{jobs}} j ON p.job_id = j.job_id""")
def _(t: Tables):
    df = R_product(t)
    return O.expected_product_flags(df).select("job_id", "seq", "type", "job_active", "is_multispectral", "is_viewable")


def R_product(t: Tables):
    return O.product_dataset(t.products, t.datasets, t.jobs)


@query("job_dataset", """SELECT job_id, org_id, coalesce(name, 'Unknown') AS dataset_name FROM {jobs} j
  LEFT JOIN (SELECT * FROM {datasets} WHERE dataset_id % 10 <> 0) d ON j.dataset_id = d.dataset_id""")
def _(t: Tables):
    return O.job_dataset(t.jobs, t.datasets.where("dataset_id % 10 <> 0")).select("job_id", "org_id", "dataset_name")


@query("product_dataset", """SELECT p.job_id, seq, type, coalesce(name, 'Unknown') AS dataset_name, status AS job_status
  FROM {products} p LEFT JOIN {datasets} d ON p.dataset_id = d.dataset_id LEFT JOIN {jobs} j ON p.job_id = j.job_id""")
def _(t: Tables):
    return R_product(t).select("job_id", "seq", "type", "dataset_name", "job_status")


@query("org_scope", "SELECT image_id, status FROM {images} WHERE dataset_id IN (SELECT dataset_id FROM {datasets} WHERE org_id = 9)")
def _(t: Tables):
    return O.org_scope(t.images, t.datasets, 9).select("image_id", "status")


@query("product_missing", f"""WITH made AS (SELECT job_id, type FROM {{products}} GROUP BY 1, 2),
  spectral AS (SELECT DISTINCT job_id FROM made WHERE type IN ({quoted(K.MULTISPECTRAL_PRODUCTS)}))
  SELECT j.job_id, e.type, CASE WHEN e.type IN ({quoted(K.MULTISPECTRAL_PRODUCTS)}) AND j.analysis_mode IN ('fast', 'draft')
  AND j.job_id NOT IN (SELECT job_id FROM spectral) THEN 'multispectral' ELSE 'core' END AS part
  FROM {{jobs}} j CROSS JOIN (SELECT unnest([{quoted(K.EXPECTED_PRODUCTS)}]) AS type) e
  WHERE NOT EXISTS (SELECT 1 FROM made m WHERE m.job_id = j.job_id AND m.type = e.type)""")
def _(t: Tables):
    return R.product_missing(t.jobs, t.products)


@query("new_files", """SELECT file_name, min(length) AS length FROM (SELECT regexp_extract(path, '[^/]*$') AS file_name,
  length, file_id FROM {files}) WHERE file_name NOT IN (SELECT regexp_extract(path, '[^/]*$') FROM {files} WHERE file_id % 3 = 0)
  GROUP BY file_name""")
def _(t: Tables):
    named = t.files.select("file_id", F.regexp_extract("path", r"[^/]*$", 0).alias("file_name"), "length")
    old = named.where("file_id % 3 = 0")
    return R.new_files(named.drop("file_id"), old).select("file_name", F.col("length").cast("long").alias("length"))


@query("latest_failed_error", """SELECT dataset_id, error_message FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id
  ORDER BY updated_at DESC, image_id DESC, error_message DESC) AS rn FROM {images} WHERE file_type = 'ARCHIVE'
  AND status = 'FAILED' AND error_message IS NOT NULL) WHERE rn = 1""")
def _(t: Tables):
    return A.latest_failed_error(t.images)


@query("latest_archive", """SELECT dataset_id, image_id, a.status, status_label FROM (SELECT *, row_number() OVER
  (PARTITION BY dataset_id ORDER BY created_at DESC, updated_at DESC, image_id DESC, status DESC, file_size DESC) AS rn
  FROM {images} WHERE file_type = 'ARCHIVE') a JOIN {statuses} s ON a.status = s.status WHERE rn = 1""")
def _(t: Tables):
    return A.latest_archive(t.images, t.statuses).select("dataset_id", "image_id", "status", "status_label")


@query("webhook_fanout", """SELECT event_id, hook_id, url, event_type FROM {events} JOIN (SELECT hook_id, org_id, url,
  unnest(string_split(event_list, ',')) AS et FROM {hooks} WHERE active) ON event_type = et""")
def _(t: Tables):
    hooks = t.hooks.withColumn("events", F.split("event_list", ","))
    return R.webhook_fanout(t.events.select("event_id", "event_type"), hooks).select(
        "event_id", "hook_id", "url", "event_type")


MARKS_SQL = """SELECT lpad(cast(s_suppkey * 7 % 10000 AS STRING), 4, '0') AS seq, s_acctbal / 1000 AS lat,
  s_acctbal / 2000 AS lon, s_acctbal AS alt FROM {supplier}"""


@query("ppk_upgrade", f"""SELECT capture_id, m.seq IS NOT NULL AS upgraded, coalesce(m.lat, c.lat) AS lat,
  coalesce(m.lon, c.lon) AS lon, coalesce(m.alt, c.alt) AS alt FROM (SELECT *,
  nullif(regexp_extract(file_name, '_(\\d{{4}})_[A-Za-z]\\.', 1), '') AS seq FROM {{captures}}) c
  LEFT JOIN ({MARKS_SQL}) m ON c.seq = m.seq""")
def _(t: Tables):
    marks = t.supplier.select(F.lpad((F.col("s_suppkey") * 7 % 10000).cast("string"), 4, "0").alias("seq"),
                              (F.col("s_acctbal") / 1000).alias("lat"), (F.col("s_acctbal") / 2000).alias("lon"),
                              F.col("s_acctbal").alias("alt"))
    return R.ppk_upgrade(t.captures, marks).select("capture_id", "upgraded", "lat", "lon", "alt")


@query("gcp_match", "SELECT g.id, g.x, g.y, g.z, e.x AS est_x, e.y AS est_y, e.z AS est_z FROM {gcps} g JOIN {estimates} e ON g.id = e.id")
def _(t: Tables):
    return R.gcp_match(t.gcps, t.estimates)


STATES = ["pending", "queued", "processing", "completed", "failed", "cancelled"]
N_STATES = ", ".join(f"count(*) FILTER (status = '{s}') AS n_{s}" for s in STATES)


@query("job_summary", f"SELECT count(*) AS total_jobs, {N_STATES}, coalesce(avg(progress), 0) AS avg_progress FROM {{jobs}} j "
       "JOIN {datasets} d ON j.dataset_id = d.dataset_id WHERE org_id = 7")
def _(t: Tables):
    return A.job_summary(O.job_filter(t.jobs, t.datasets, org=7))


@query("product_summary", f"""SELECT category, type, count(*) AS n FROM (SELECT type, {CATEGORY_SQL} AS category
  FROM {{products}}) GROUP BY ROLLUP (category, type)""")
def _(t: Tables):
    return A.product_summary(t.products)


@query("dataset_stats", """WITH f AS (SELECT dataset_id, string_agg(concat(k, '=', cast(n AS STRING)), ',' ORDER BY k) AS by_file_type
    FROM (SELECT dataset_id, coalesce(file_type, 'UNKNOWN') AS k, count(*) AS n FROM {images} GROUP BY 1, 2) GROUP BY 1),
  c AS (SELECT dataset_id, string_agg(concat(k, '=', cast(n AS STRING)), ',' ORDER BY k) AS by_content_type
    FROM (SELECT dataset_id, coalesce(content_type, 'unknown') AS k, count(*) AS n FROM {images} GROUP BY 1, 2) GROUP BY 1)
  SELECT i.dataset_id, count(*) AS image_count, cast(sum(file_size) AS BIGINT) AS total_size,
  round(sum(file_size) / (1024 * 1024), 2) AS total_size_mb, any_value(by_file_type) AS by_file_type,
  any_value(by_content_type) AS by_content_type FROM {images} i JOIN f ON i.dataset_id = f.dataset_id
  JOIN c ON i.dataset_id = c.dataset_id GROUP BY i.dataset_id""")
def _(t: Tables):
    def text(col: str):
        parts = F.transform(F.map_entries(col), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
        return F.array_join(parts, ",").alias(col)
    return A.dataset_stats(t.images).select("dataset_id", "image_count", "total_size", "total_size_mb",
                                            text("by_file_type"), text("by_content_type"))


@query("user_dataset_stats", """WITH e AS (SELECT dataset_id, error_message FROM (SELECT *, row_number() OVER (PARTITION BY
  dataset_id ORDER BY updated_at DESC, image_id DESC, error_message DESC) AS rn FROM {images} WHERE file_type = 'ARCHIVE'
  AND status = 'FAILED' AND error_message IS NOT NULL) WHERE rn = 1), s AS (SELECT dataset_id,
  count(*) FILTER (file_type = 'IMAGE') AS total_files, cast(sum(file_size) FILTER (file_type = 'ARCHIVE') AS BIGINT) AS total_size,
  count(*) FILTER (file_type = 'ARCHIVE' AND status IN ('PROCESSING', 'PENDING', 'DOWNLOADING')) AS busy,
  count(*) FILTER (file_type = 'ARCHIVE' AND status = 'FAILED') AS bad FROM {images} GROUP BY 1)
  SELECT d.dataset_id, name, coalesce(total_files, 0) AS total_files, total_size, created_at, CASE WHEN busy > 0 THEN 'PROCESSING'
  WHEN bad > 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status, error_message FROM {datasets} d LEFT JOIN s ON
  d.dataset_id = s.dataset_id LEFT JOIN e ON d.dataset_id = e.dataset_id WHERE user_id = 12""")
def _(t: Tables):
    return A.user_dataset_stats(t.datasets, t.images, user=12)


@query("dashboard_month", """SELECT (SELECT count(*) FROM {datasets} WHERE created_at >= TIMESTAMP '1999-06-01' AND created_at <
  TIMESTAMP '1999-07-01') AS total_datasets, (SELECT count(*) FROM {products} WHERE created_at >= TIMESTAMP '1999-06-01' AND
  created_at < TIMESTAMP '1999-07-01') AS total_products, (SELECT count(*) FROM {jobs} WHERE status = 'completed' AND updated_at >=
  TIMESTAMP '1999-06-01' AND updated_at < TIMESTAMP '1999-07-01') AS total_completed_jobs""")
def _(t: Tables):
    return A.dashboard_month(t.datasets, t.products, t.jobs, as_of())


KPI_SQL = f"""SELECT count(*) AS total_jobs, {N_STATES},
  coalesce(round(avg(took) FILTER (status = 'completed' AND took IS NOT NULL), 2), 0) AS avg_processing_seconds,
  count(*) FILTER (status = 'completed' AND took IS NOT NULL) AS timed_jobs,
  coalesce(round(avg(waited), 2), 0) AS avg_queue_wait_seconds,
  count(*) FILTER (status = 'completed' AND age <= 3600) AS completed_last_1h,
  count(*) FILTER (status = 'completed' AND age <= 86400) AS completed_last_24h,
  round(count(*) FILTER (status = 'completed' AND age <= 86400) / 24, 2) AS per_hour_24h,
  count(*) FILTER (status = 'failed' AND age <= 86400) AS failed_last_24h
  FROM (SELECT *, date_diff('second', started_at, completed_at) AS took, date_diff('second', created_at, started_at) AS waited,
  date_diff('second', completed_at, TIMESTAMP '{AS_OF_TEXT}') AS age FROM {{jobs}})"""


@query("kpi_backend", KPI_SQL)
def _(t: Tables):
    return A.kpi_backend(t.jobs, as_of())


@query("kpi_service", """SELECT count(*) FILTER (status = 'completed') AS jobs_processed, count(*) FILTER (status = 'failed') AS jobs_failed,
  count(*) FILTER (status IN ('pending', 'queued', 'processing')) AS jobs_in_progress,
  round(cast(sum(took) FILTER (status = 'completed') AS DOUBLE), 2) AS total_processing_seconds,
  round(avg(took) FILTER (status = 'completed'), 2) AS average_processing_seconds,
  round(count(*) FILTER (status = 'completed') / 1000, 2) AS throughput_per_hour,
  round(cast(sum(waited) AS DOUBLE), 2) AS queue_wait_total, count(waited) AS queue_wait_count, round(avg(waited), 2) AS queue_wait_avg
  FROM (SELECT *, date_diff('second', coalesce(started_at, created_at), coalesce(completed_at, updated_at)) AS took,
  date_diff('second', created_at, started_at) AS waited FROM {jobs})""")
def _(t: Tables):
    return A.kpi_service(t.jobs, uptime_hours=1000.0)


@query("bench_summary", """SELECT stage, count(*) AS total_runs, count(*) FILTER (success) AS successful_runs,
  count(*) FILTER (NOT success) AS failed_runs, round(count(*) FILTER (success) / count(*), 6) AS success_rate,
  min(elapsed_seconds) FILTER (success) AS min_seconds, max(elapsed_seconds) FILTER (success) AS max_seconds,
  round(avg(elapsed_seconds) FILTER (success), 6) AS mean_seconds FROM {runs} GROUP BY stage""")
def _(t: Tables):
    return A.bench_summary(t.runs).withColumns({c: r6(c) for c in ("success_rate", "mean_seconds")})


@query("bench_verdict", """SELECT count(*) AS total_runs, count(*) FILTER (success) AS total_passed, count(*) FILTER (NOT success)
  AS total_failed, round(sum(elapsed_seconds), 4) AS total_time_seconds, bool_and(success) AS all_stages_passed,
  (SELECT count(*) = 0 FROM {validations} WHERE NOT passed AND validator IN ('radiometric', 'vegetation', 'visual', 'performance'))
  AS validation_passed, CASE WHEN bool_and(success) AND (SELECT count(*) = 0 FROM {validations} WHERE NOT passed AND validator
  IN ('radiometric', 'vegetation', 'visual', 'performance')) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM {runs}""")
def _(t: Tables):
    return A.bench_verdict(t.runs, t.validations).withColumn("total_time_seconds", r6("total_time_seconds", 4))


@query("perf_metrics", """SELECT stage, round(sum(image_count) FILTER (success) / sum(elapsed_seconds) FILTER (success) * 60, 6)
  AS images_per_min, round(sum(output_bytes) FILTER (success) / 1048576e0 / sum(elapsed_seconds) FILTER (success), 6) AS
  storage_mb_per_s, round(avg(start_time - submit_time), 6) AS queue_latency FROM {runs} GROUP BY stage""")
def _(t: Tables):
    return A.perf_metrics(t.runs).withColumns({c: r6(c) for c in ("images_per_min", "storage_mb_per_s", "queue_latency")})


@query("scaling_efficiency", """SELECT round(avg(elapsed_seconds) FILTER (gpu_count = 1) / avg(elapsed_seconds) FILTER (gpu_count > 1)
  / arg_max(gpu_count, stage_order * 100000000 + run_index) FILTER (gpu_count > 1), 6) AS scaling_efficiency,
  arg_max(gpu_count, stage_order * 100000000 + run_index) FILTER (gpu_count > 1) AS gpu_count
  FROM {runs} WHERE success AND gpu_count IS NOT NULL""")
def _(t: Tables):
    return A.scaling_efficiency(t.runs).withColumn("scaling_efficiency", r6("scaling_efficiency"))


@query("upload_outcome", """SELECT job_id, count(*) FILTER (uri IS NOT NULL) AS uploaded, count(*) FILTER (uri IS NULL) AS failed,
  coalesce(string_agg(DISTINCT type, ',' ORDER BY type) FILTER (uri IS NULL), '') AS failed_types,
  count(*) FILTER (uri IS NULL AND type = 'orthomosaic') > 0 AS critical FROM {products} GROUP BY job_id""")
def _(t: Tables):
    out = A.upload_outcome(t.products.withColumn("ok", F.col("uri").isNotNull()))
    return out.withColumn("failed_types", F.array_join("failed_types", ","))


@query("reconstruction_stats", """SELECT (SELECT count(*) FROM {supplier}) AS cameras, (SELECT count(*) FROM {orders}) AS images,
  count(DISTINCT image_id) AS registered, count(DISTINCT point_id) AS points, round(count(*) / count(DISTINCT point_id), 6)
  AS mean_track_length, round(count(*) / count(DISTINCT image_id), 6) AS mean_observations, round(avg(error), 6) AS mean_error
  FROM {observations}""")
def _(t: Tables):
    out = A.reconstruction_stats(t.supplier, t.orders, t.observations)
    return out.withColumns({c: r6(c) for c in ("mean_track_length", "mean_observations", "mean_error")})


@query("dense_sparse_ratio", """SELECT (SELECT count(*) FROM {lineitem}) AS dense_points, (SELECT count(*) FROM {orders}) AS sparse_points,
  round((SELECT count(*) FROM {lineitem}) / (SELECT count(*) FROM {orders}), 6) AS ratio""")
def _(t: Tables):
    return A.dense_sparse_ratio(t.lineitem, t.orders).withColumn("ratio", r6("ratio"))


@query("downsample_stats", """SELECT count(*) FILTER (status <> 'FAILED') AS processed, count(*) FILTER (status = 'FAILED') AS failed,
  round((1 - sum(after) FILTER (status <> 'FAILED') / sum(file_size) FILTER (status <> 'FAILED')) * 100, 6) AS reduction_pct
  FROM (SELECT status, file_size, cast(floor(file_size / 3) AS BIGINT) AS after FROM {images})""")
def _(t: Tables):
    df = t.images.select((F.col("status") != "FAILED").alias("ok"), F.col("file_size").alias("bytes_before"),
                         F.floor(F.col("file_size") / 3).alias("bytes_after"))
    return A.downsample_stats(df).withColumn("reduction_pct", r6("reduction_pct"))


@query("order_whitelist", "SELECT job_id, progress FROM {jobs} ORDER BY progress DESC, job_id")
def _(t: Tables):
    return S.order_whitelist(t.jobs, "-progress").select("job_id", "progress")


@query("paginate", """SELECT job_id, status, progress, (SELECT count(*) FROM {jobs}) AS total, (SELECT count(*) FROM {jobs}) > 150
  AS has_next, true AS has_previous FROM {jobs} ORDER BY progress, job_id LIMIT 50 OFFSET 100""")
def _(t: Tables):
    ordered = S.order_whitelist(t.jobs, "progress").select("job_id", "status", "progress")
    return S.paginate(ordered, page=3, page_size=50)


@query("recent_activity", """SELECT * FROM ((SELECT 'dataset' AS kind, dataset_id AS id, created_at FROM {datasets}) UNION ALL
  (SELECT 'job', job_id, created_at FROM {jobs})) ORDER BY created_at DESC, kind, id LIMIT 20""")
def _(t: Tables):
    return S.recent_activity(t.datasets, t.jobs)


@query("top1_product_run", """SELECT dataset_id, created_at, job_id, type FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id
  ORDER BY created_at DESC, job_id DESC, type DESC) AS rn FROM {products}) WHERE rn = 1""")
def _(t: Tables):
    return S.top1_product_run(t.products.select("dataset_id", "created_at", "job_id", "type"))


@query("stale_jobs", f"SELECT job_id, status, updated_at FROM {{jobs}} WHERE updated_at < TIMESTAMP '{AS_OF_TEXT}' - INTERVAL '1' DAY")
def _(t: Tables):
    from swathline.streaming.retention import stale_jobs
    return stale_jobs(t.jobs, as_of(), days=1).select("job_id", "status", "updated_at")
