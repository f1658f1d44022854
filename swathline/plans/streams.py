"""Queries over callback and metric streams: batch twins, and the same folds run as streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathline.functions import constants as K
from swathline.functions.scalars import rounded as r6
from swathline.operators import aggregates as A
from swathline.plans.registry import query
from swathline.plans.views import Tables
from swathline.session import shared_folder
from swathline.streaming import callbacks as C
from swathline.streaming import retention as T
from swathline.streaming import sinks
from swathline.streaming import windows as W

STAGES_SQL = ", ".join(f"'{s}'" for s in K.STAGES)
O = "strftime(ts, '%Y%m%d%H%M%S%f') || lpad(cast(event_id AS STRING), 12, '0')"
FOLD_SQL = f"""WITH c AS (SELECT *, {O} AS o, type = 'complete' AS done, type = 'error' AS err, type = 'upload_status' AND failed_types <> '' AS bad, type = 'progress' AS prog FROM {{callbacks}} WHERE type IN ('progress', 'complete', 'error', 'upload_status'))
  SELECT job_id, count(*) AS events, arg_max(CASE WHEN done THEN 100 ELSE progress END, o) FILTER (prog OR done) AS progress,
  arg_max(CASE WHEN done THEN 'completed' WHEN prog THEN current_stage ELSE 'failed' END, o) FILTER (done OR err OR bad OR (prog AND current_stage IN ({STAGES_SQL}))) AS stage,
  arg_max(CASE WHEN done THEN 'completed' ELSE 'failed' END, o) FILTER (done OR err OR bad) AS status,
  nullif(arg_max(CASE WHEN err THEN error_message WHEN bad THEN concat('Failed to upload products: ', replace(failed_types, ',', ', ')) ELSE '' END, o) FILTER (done OR err OR bad), '') AS error_message,
  arg_max(CASE WHEN done THEN 'completed' ELSE current_stage END, o) FILTER (done OR (prog AND current_stage IS NOT NULL AND stage_progress = 100)) AS last_successful_stage,
  max(ts) FILTER (done OR err) AS completed_at FROM c GROUP BY job_id"""


@query("callback_fold", FOLD_SQL)
def _(t: Tables):
    return C.callback_fold(t.callbacks)


@query("callback_rejects", "SELECT event_id, job_id, type FROM {callbacks} WHERE type = 'ping'")
def _(t: Tables):
    return C.callback_rejects(t.callbacks).select("event_id", "job_id", "type")


@query("running_status", f"""SELECT job_id, arg_max(current_stage, {O}) AS last_stage, max(ts) AS finished_at FROM {{callbacks}} WHERE type = 'progress' AND stage_progress = 100 AND current_stage IS NOT NULL GROUP BY job_id""")
def _(t: Tables):
    return C.running_status(t.callbacks)


NEXT_SQL = "CASE stage WHEN 'radiometric_calibration' THEN 'sfm' WHEN 'sfm' THEN 'orthomosaic' WHEN 'orthomosaic' THEN 'uploading' WHEN 'uploading' THEN 'publishing' ELSE 'completed' END"
DURATION_SQL = f"""SELECT event_id, job_id, stage, round(date_diff('microsecond', started, ts) / 1e6, 6) AS duration_seconds, {NEXT_SQL} AS next_stage FROM (SELECT *, max(CASE WHEN action = 'start' THEN ts END)
  OVER (PARTITION BY job_id, stage ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS started FROM {{stage_events}}) WHERE action = 'complete'"""


@query("stage_durations", DURATION_SQL)
def _(t: Tables):
    return C.stage_durations(t.stage_events).select("event_id", "job_id", "stage", r6("duration_seconds").alias("duration_seconds"), "next_stage")


PERCENT_SQL = "CASE stg WHEN 'radiometric_calibration' THEN 5e0 WHEN 'sfm' THEN 15e0 WHEN 'orthomosaic' THEN 60e0 WHEN 'uploading' THEN 90e0 WHEN 'publishing' THEN 95e0 ELSE 100e0 END"


STATE_SQL = f"""SELECT job_id, coalesce(status, 'pending') AS status, stg AS current_stage, CASE WHEN stg IS NOT NULL THEN {PERCENT_SQL} END AS progress, updated_at FROM (SELECT job_id,
  arg_max(CASE action WHEN 'start' THEN 'running' WHEN 'fail' THEN 'failed' ELSE 'completed' END, {O}) FILTER (action <> 'complete' OR stage = 'publishing') AS status,
  arg_max(CASE WHEN action = 'start' THEN stage ELSE {NEXT_SQL} END, {O}) FILTER (action <> 'fail') AS stg, max(ts) AS updated_at FROM {{stage_events}} GROUP BY job_id)"""


@query("stage_machine", STATE_SQL)
def _(t: Tables):
    return C.stage_machine(t.stage_events)


@query("kpi_stage", f"""SELECT stage, round(sum(duration_seconds), 2) AS total_seconds, round(avg(duration_seconds), 2) AS avg_seconds, count(*) AS n FROM ({DURATION_SQL}) WHERE duration_seconds IS NOT NULL GROUP BY stage""")
def _(t: Tables):
    return A.kpi_stage(C.stage_durations(t.stage_events))


@query("ttl_expiry", """SELECT job_id, max(ts) AS last_write, max(ts) + INTERVAL '72' HOUR AS expires_at, max(ts) + INTERVAL '72' HOUR <= TIMESTAMP '2024-02-02 00:00:00' AS expired FROM {callbacks} GROUP BY job_id""")
def _(t: Tables):
    return T.ttl_expiry(t.callbacks, F.lit("2024-02-02 00:00:00").cast("timestamp_ntz"))


HOUR_SQL = "SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM {callbacks} WHERE type = 'error' GROUP BY 1"


def errors(t: Tables) -> DataFrame:
    return t.callbacks.where("type = 'error'").select("ts", "type")


def hours(df: DataFrame) -> DataFrame:
    return df.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("hourly_counter", HOUR_SQL)
def _(t: Tables):
    return hours(W.hourly_counter(errors(t)))


@query("rolling_hours", f"WITH h AS ({HOUR_SQL}) SELECT a.hour, any_value(a.n) AS last_1h, cast(sum(b.n) AS BIGINT) AS last_24h FROM h a JOIN h b ON b.hour > a.hour - INTERVAL '24' HOUR AND b.hour <= a.hour GROUP BY a.hour")
def _(t: Tables):
    return W.rolling_hours(hours(W.hourly_counter(errors(t))))


THROUGHPUT_SQL = """SELECT s AS start, s + INTERVAL '24' HOUR AS "end", count(*) FILTER (type = 'complete') AS completed, count(*) FILTER (type = 'error') AS failed FROM (SELECT type, date_trunc('hour', ts) - INTERVAL '1' HOUR * k AS s FROM {callbacks}
  CROSS JOIN range(24) AS t(k)) GROUP BY s"""


@query("throughput_window", THROUGHPUT_SQL)
def _(t: Tables):
    return spans(W.throughput_window(t.callbacks))


def spans(w: DataFrame) -> DataFrame:
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "completed", "failed")


ALARM_SQL = """WITH p AS (SELECT event_type AS metric, time_bucket(INTERVAL '5 minutes', ts) AS s, avg(value) AS mean FROM {events} GROUP BY 1, 2) SELECT a.metric, a.s AS start, round(a.mean, 6) AS mean FROM p a JOIN p b ON a.metric = b.metric AND b.s = a.s - INTERVAL '5 minutes'
  WHERE a.mean > 10 AND b.mean > 10"""


@query("alarm", ALARM_SQL)
def _(t: Tables):
    means = W.period_means(t.events.select(F.col("event_type").alias("metric"), "ts", "value"))
    return W.alarm(means, 10.0).select("metric", F.col("start").cast("timestamp_ntz").alias("start"), r6("mean").alias("mean"))


PRODUCT_SQL = """SELECT dataset_id, job_id, type, count(*) AS versions, nullif(arg_max(coalesce(uri, ''), o), '') AS uri, arg_max(resolution_cm, o) AS resolution_cm, min(created_at) AS created_at FROM (SELECT *, concat(strftime(created_at, '%Y%m%d'), lpad(cast(seq AS STRING), 4, '0'),
  lpad(cast(revision AS STRING), 9, '0'), '|', coalesce(uri, ''), '|', lpad(cast(cast(round(resolution_cm * 10) AS BIGINT) AS STRING), 6, '0')) AS o FROM {products}) GROUP BY 1, 2, 3"""


@query("dedupe_product", PRODUCT_SQL)
def _(t: Tables):
    return C.dedupe_product(t.products)


# --- the same folds run as streams until the input is used up ----------------------------------------------------

def streamed(t: Tables, name: str = "events") -> Tables:
    """Tables of which one arrives as a file stream."""
    live = Tables(t.spark, t.folder)
    live._known[name] = (t.spark.readStream.schema(getattr(t, name).schema).option("pathGlobFilter", f"{name}.parquet")
                         .parquet(t.folder))
    return live


#: For files whose rows recur: a page ends by its bytes, not after 20000 rows, so that what recurs is kept once a megabyte.
COMPACT = {"compression": "zstd", "parquet.page.row.count.limit": 1_000_000}


def run_to_end(df: DataFrame, mode: str, keys: tuple[str, ...] = (), each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Write a stream to the shared folder until its input is used up, and read the result back.

    In update mode every batch appends the rows that have changed, under its number, and the newest row of each of the
    ``keys`` is read back; a batch that is run again appends the same rows.  ``each`` makes the rows of a batch from those that came,
    by itself (append mode only); they are left under the batch's number, and a batch that is run again overwrites them.
    """
    spark = df.sparkSession
    base = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if each:
        schema = each(df).schema
        spark.createDataFrame([], schema).write.parquet(f"{base}/out/batch=-1")  # a stream without batches has no rows
        running = writer.foreachBatch(lambda part, batch: each(part).write.mode("overwrite").options(**COMPACT).parquet(f"{base}/out/batch={batch}")).start()
        running.awaitTermination()
        return spark.read.schema(schema).parquet(f"{base}/out").select(*schema.names)
    if mode == "append":
        running = writer.format("parquet").option("path", f"{base}/out").start()
    elif mode == "update":
        running = writer.foreachBatch(lambda part, batch: part.withColumn("_batch", F.lit(batch)).write.mode("append").parquet(f"{base}/out")).start()
    else:
        running = writer.foreachBatch(lambda part, _: part.write.mode("overwrite").parquet(f"{base}/out")).start()
    running.awaitTermination()
    if mode == "update":
        rest = [c for c in df.columns if c not in keys]
        columns = ", ".join(f"`{c}` {kind}" for c, kind in [*df.dtypes, ("_batch", "bigint")])
        log = spark.read.schema(columns).parquet(f"{base}/out")
        return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*keys, "r.*").select(*df.columns)
    return spark.read.schema(df.schema).parquet(f"{base}/out")


@query("stream_callback_fold", FOLD_SQL)
def _(t: Tables):
    return run_to_end(C.callback_fold(streamed(t).callbacks), "update", ("job_id",))


@query("stream_hourly_counter", HOUR_SQL)
def _(t: Tables):
    return hours(run_to_end(W.hourly_counter(errors(streamed(t))), "update", ("hour",)))


@query("stream_alarm", ALARM_SQL)
def _(t: Tables):
    live = streamed(t).events.select(F.col("event_type").alias("metric"), "ts", "value")
    out = run_to_end(W.alarm_states(live, 10.0), "update", ("metric", "start")).where("fires")
    return out.select("metric", F.col("start").cast("timestamp_ntz").alias("start"), r6("mean").alias("mean"))


@query("stream_stage_machine", f"SELECT event_id, job_id, stage, duration_seconds FROM ({DURATION_SQL})")
def _(t: Tables):
    return run_to_end(C.stage_machine_stream(streamed(t).stage_events), "append").withColumn("duration_seconds", r6("duration_seconds"))


@query("webhook_stream", """SELECT event_id, hook_id, url, event_type FROM {events} JOIN (SELECT hook_id, url, unnest(string_split(event_list, ',')) AS et FROM {hooks} WHERE active) ON event_type = et""")
def _(t: Tables):
    hooks = t.hooks.withColumn("events", F.split("event_list", ","))
    live = streamed(t).events.select("event_id", "event_type")
    return run_to_end(live, "append", each=lambda part: W.webhook_stream(part, hooks).select("event_id", "hook_id", "url", "event_type"))


@query("stream_throughput_window", THROUGHPUT_SQL)
def _(t: Tables):
    return spans(run_to_end(W.throughput_window(streamed(t).callbacks.select("ts", "type")), "update", ("start", "end")))


@query("stream_callback_state", FOLD_SQL)
def _(t: Tables):
    out = run_to_end(C.callback_fold_stream(streamed(t).callbacks), "update", ("job_id",))
    return out.select(*C.callback_fold(t.callbacks).columns)


@query("stream_stage_state", STATE_SQL)
def _(t: Tables):
    return run_to_end(C.stage_state_stream(streamed(t).stage_events), "update", ("job_id",)).drop("expired")


@query("stream_stage_moves", DURATION_SQL)
def _(t: Tables):
    out = run_to_end(C.stage_machine_stream(streamed(t).stage_events, following=True), "append")
    return out.withColumn("duration_seconds", r6("duration_seconds"))


@query("stream_dedupe_product", PRODUCT_SQL)
def _(t: Tables):
    parts = C.product_parts(streamed(t, "lineitem").products)
    base = f"{shared_folder(t.spark)}/streams/{uuid.uuid4().hex}"
    table = sinks.MergedTable(t.spark, f"{base}/table", parts.schema, C.merge_products)
    writer = parts.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    writer.foreachBatch(table.write).start().awaitTermination()
    return C.finish_products(table.read())
