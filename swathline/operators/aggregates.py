"""Counts, sums and key figures over datasets, jobs, products and runs.

Every aggregate here is mergeable, so Spark combines inside the map tasks and a hot key ships one
partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathline.functions import constants as K
from swathline.functions.scalars import exact_sum
from swathline.operators.filters import product_category, seconds_between

def job_summary(jobs: DataFrame) -> DataFrame:
    """One row: how many jobs, how many in each status, average progress (0 when there are none)."""
    states = ["pending", "queued", "processing", "completed", "failed", "cancelled"]
    return jobs.agg(
        F.count("*").alias("total_jobs"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in states],
        F.coalesce(F.avg("progress"), F.lit(0.0)).alias("avg_progress"))


def product_summary(products: DataFrame) -> DataFrame:
    """Counts by type and by category, plus the total, in one pass; NULL marks a summed level."""
    return (product_category(products)
            .rollup("category", "type").agg(F.count("*").alias("n"))
            .select("category", "type", "n"))


def dataset_stats(images: DataFrame) -> DataFrame:
    """Per dataset: images, bytes, megabytes, and maps of counts by file type and content type.

    Images are read once into rows per (dataset, file type, content type); everything else adds those up.
    """
    base = images.groupBy(
        "dataset_id", F.coalesce("file_type", F.lit("UNKNOWN")).alias("file_type"),
        F.coalesce("content_type", F.lit("unknown")).alias("content_type")).agg(
        F.count("*").alias("n"), F.sum("file_size").alias("size"))

    def counted(col: str) -> DataFrame:
        grouped = base.groupBy("dataset_id", F.col(col).alias("kind")).agg(F.sum("n").alias("n"))
        pairs = F.sort_array(F.collect_list(F.struct("kind", "n")))
        return grouped.groupBy("dataset_id").agg(F.map_from_entries(pairs).alias(f"by_{col}"))

    totals = base.groupBy("dataset_id").agg(
        F.sum("n").alias("image_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"))
    return (totals
            .withColumn("total_size_mb", F.round(F.col("total_size") / (1024 * 1024), 2))
            .join(counted("file_type"), "dataset_id").join(counted("content_type"), "dataset_id"))


def dataset_status(datasets: DataFrame, images: DataFrame) -> DataFrame:
    """Image counts by upload status and the status they imply, for every dataset."""
    per = images.groupBy("dataset_id").agg(
        F.count("*").alias("image_count"), F.sum("file_size").alias("total_size"),
        *[F.count_if(F.col("status") == s).alias(f"{s.lower()}_count")
          for s in ("PENDING", "PROCESSING", "COMPLETED", "FAILED")])
    counts = ["image_count", "total_size", "pending_count", "processing_count", "completed_count",
              "failed_count"]
    df = datasets.join(per, "dataset_id", "left").fillna(0, counts)
    status = (F.when(F.col("failed_count") > 0, "HAS_ERROR")
              .when(F.col("processing_count") > 0, "PROCESSING")
              .when((F.col("image_count") == F.col("completed_count")) & (F.col("completed_count") > 0),
                    "COMPLETED")
              .otherwise("PENDING"))
    return df.withColumn("status", status)


def latest_failed_error(images: DataFrame) -> DataFrame:
    """Newest error text of a failed archive, per dataset."""
    bad = images.where((F.col("file_type") == "ARCHIVE") & (F.col("status") == "FAILED")
                       & F.col("error_message").isNotNull())
    newest = F.max_by("error_message", F.struct("updated_at", "image_id", "error_message"))
    return bad.groupBy("dataset_id").agg(newest.alias("error_message"))


def latest_archive(images: DataFrame, statuses: DataFrame) -> DataFrame:
    """Newest archive record per dataset with its status label."""
    rec = F.struct("created_at", "updated_at", "image_id", "status", "file_size")
    newest = (images.where(F.col("file_type") == "ARCHIVE")
              .groupBy("dataset_id").agg(F.max(rec).alias("r")).select("dataset_id", "r.*"))
    return newest.join(statuses, "status", "left")


def user_dataset_stats(datasets: DataFrame, images: DataFrame, user: int) -> DataFrame:
    mine = datasets.where(F.col("user_id") == user).dropDuplicates(["dataset_id"])
    archive = F.col("file_type") == "ARCHIVE"
    images = images.join(mine.select("dataset_id"), "dataset_id", "left_semi")
    per = images.groupBy("dataset_id").agg(
        F.count_if(F.col("file_type") == "IMAGE").alias("total_files"),
        F.sum(F.when(archive, F.col("file_size"))).alias("total_size"),
        F.count_if(archive & F.col("status").isin("PROCESSING", "PENDING", "DOWNLOADING")).alias("busy"),
        F.count_if(archive & (F.col("status") == "FAILED")).alias("bad"))
    df = mine.join(per, "dataset_id", "left").fillna(0, ["total_files", "busy", "bad"])
    df = df.withColumn("status", F.when(F.col("busy") > 0, "PROCESSING").when(F.col("bad") > 0, "FAILED")
                       .otherwise("COMPLETED"))
    return (df.join(latest_failed_error(images), "dataset_id", "left")
            .select("dataset_id", "name", "total_files", "total_size", "created_at", "status",
                    "error_message"))


def dashboard_month(datasets: DataFrame, products: DataFrame, jobs: DataFrame, as_of: Column,
                    org: int | None = None) -> DataFrame:
    """Datasets, products and finished jobs in the calendar month of ``as_of``, as one row."""
    first = F.date_trunc("month", as_of).cast("timestamp_ntz")
    after = F.add_months(first, 1).cast("timestamp_ntz")

    def counted(df: DataFrame, col: str, name: str) -> DataFrame:
        inside = df.where((F.col(col) >= first) & (F.col(col) < after))
        if org is not None:
            mine = datasets.where(F.col("org_id") == org).select("dataset_id")
            inside = inside.join(mine, "dataset_id", "left_semi")
        return inside.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")

    parts = counted(datasets, "created_at", "d").unionByName(
        counted(products, "created_at", "p")).unionByName(
        counted(jobs.where(F.col("status") == "completed"), "updated_at", "j"))

    def pick(w: str) -> Column:
        return F.max(F.when(F.col("what") == w, F.col("n")))

    return parts.agg(pick("d").alias("total_datasets"), pick("p").alias("total_products"),
                     pick("j").alias("total_completed_jobs"))


def kpi_backend(jobs: DataFrame, as_of: Column) -> DataFrame:
    """One pass over jobs: counts by status, mean durations, throughput up to ``as_of``."""
    done, failed = F.col("status") == "completed", F.col("status") == "failed"
    took = seconds_between(F.col("completed_at"), F.col("started_at"))
    waited = seconds_between(F.col("started_at"), F.col("created_at"))
    age = seconds_between(as_of, F.col("completed_at"))
    timed = done & F.col("started_at").isNotNull() & F.col("completed_at").isNotNull()

    def mean(cond: Column, value: Column) -> Column:
        total = exact_sum(F.when(cond, value))
        return F.coalesce(F.round(total / F.nullif(F.count_if(cond), F.lit(0)), 2), F.lit(0.0))

    states = ["pending", "queued", "processing", "completed", "failed", "cancelled"]
    day = F.count_if(done & (age <= 86400))
    return jobs.agg(
        F.count("*").alias("total_jobs"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in states],
        mean(timed, took).alias("avg_processing_seconds"),
        F.count_if(timed).alias("timed_jobs"),
        mean(F.col("started_at").isNotNull(), waited).alias("avg_queue_wait_seconds"),
        F.count_if(done & (age <= 3600)).alias("completed_last_1h"),
        day.alias("completed_last_24h"),
        F.round(day / 24.0, 2).alias("per_hour_24h"),
        F.count_if(failed & (age <= 86400)).alias("failed_last_24h"))


def kpi_stage(durations: DataFrame) -> DataFrame:
    """Per stage: total, mean and number of recorded durations (as ``stage_machine`` gives them)."""
    total = exact_sum("duration_seconds")
    return durations.where(F.col("duration_seconds").isNotNull()).groupBy("stage").agg(
        F.round(total, 2).alias("total_seconds"),
        F.round(total / F.count("*"), 2).alias("avg_seconds"),
        F.count("*").alias("n"))


def kpi_service(jobs: DataFrame, uptime_hours: float) -> DataFrame:
    """Service totals: processed, failed, active, mean time, queue wait and jobs per hour of uptime."""
    done, failed = F.col("status") == "completed", F.col("status") == "failed"
    took = seconds_between(F.coalesce("completed_at", "updated_at"), F.coalesce("started_at", "created_at"))
    waited = seconds_between(F.col("started_at"), F.col("created_at"))
    has_wait = F.col("started_at").isNotNull()
    n_done, total = F.count_if(done), F.coalesce(exact_sum(F.when(done, took)), F.lit(0.0))
    wait = F.coalesce(exact_sum(F.when(has_wait, waited)), F.lit(0.0))
    return jobs.agg(
        n_done.alias("jobs_processed"), F.count_if(failed).alias("jobs_failed"),
        F.count_if(F.col("status").isin(K.ACTIVE_STATUSES)).alias("jobs_in_progress"),
        F.round(total, 2).alias("total_processing_seconds"),
        F.coalesce(F.round(total / F.nullif(n_done, F.lit(0)), 2), F.lit(0.0)).alias("average_processing_seconds"),
        F.round(n_done / F.lit(float(uptime_hours)), 2).alias("throughput_per_hour"),
        F.round(wait, 2).alias("queue_wait_total"),
        F.count_if(has_wait).alias("queue_wait_count"),
        F.coalesce(F.round(wait / F.nullif(F.count_if(has_wait), F.lit(0)), 2), F.lit(0.0)).alias("queue_wait_avg"))


def manifest_group(classified: DataFrame) -> DataFrame:
    """One row per dataset: images per band, most frequent manufacturer and model, multispectral flag.

    Ties go to the value met first in path order.  ``classified`` has dataset_id, file_path, band,
    manufacturer, drone_model and error (NULL when the image could be read).
    """
    # each image once per thing counted: its band, and where it could be read its manufacturer and model
    path, bad = F.col("file_path"), F.col("error").isNotNull()
    counted = [(0, "band", F.lit(None).cast("string")), (1, "manufacturer", path), (2, "drone_model", path)]
    things = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value"), p.alias("first")) for k, c, p in counted])
    rows = classified.select("dataset_id", bad.alias("bad"), F.inline(things)).where("kind = 0 OR (NOT bad AND value IS NOT NULL)")
    per = rows.groupBy("dataset_id", "kind", "value").agg(
        F.count("*").alias("n"), F.count_if(~F.col("bad")).alias("good"), F.min("first").alias("first"))
    kind, value, n, good = (F.col(c) for c in ("kind", "value", "n", "good"))

    def most(k: int) -> Column:
        return F.min_by(value, F.when(kind == k, F.struct((-n).alias("n"), "first")))

    seen = (kind == 0) & (good > 0)
    bands = F.collect_list(F.when(seen, F.struct(value.alias("band"), good.alias("n"))))
    out = per.groupBy("dataset_id").agg(
        F.sum(F.when(kind == 0, n)).alias("total_images"), F.sum(F.when(kind == 0, n - good)).alias("n_errors"),
        F.sort_array(bands).alias("band_counts"),
        F.coalesce(F.max(F.when(seen, ~value.isin("rgb", "unknown"))), F.lit(False)).alias("is_multispectral"),
        F.coalesce(most(1), F.lit("unknown")).alias("manufacturer"), most(2).alias("drone_model"))
    return out.withColumn("band_counts", F.when(F.size("band_counts") > 0, F.map_from_entries("band_counts")))


def band_counts(calibrated: DataFrame, listed: int = 20) -> tuple[DataFrame, DataFrame]:
    """(counts per band, the first ``listed`` failures in path order).

    ``calibrated`` has band, file_path, state in calibrated / reflectance / failed.
    """
    counts = calibrated.groupBy("band").agg(
        F.count_if(F.col("state").isin("calibrated", "reflectance")).alias("calibrated"),
        F.count_if(F.col("state") == "reflectance").alias("reflectance"),
        F.count_if(F.col("state") == "failed").alias("failed"))
    failures = (calibrated.where(F.col("state") == "failed").select("file_path", "band")
                .orderBy("file_path", "band").limit(listed))
    return counts, failures


def bench_summary(runs: DataFrame) -> DataFrame:
    """Per stage: runs, successes, rate and seconds of the successful runs."""
    ok = F.col("success")
    good = F.count_if(ok)
    return runs.groupBy("stage").agg(
        F.count("*").alias("total_runs"), good.alias("successful_runs"),
        F.count_if(~ok).alias("failed_runs"), (good / F.count("*")).alias("success_rate"),
        F.min(F.when(ok, F.col("elapsed_seconds"))).alias("min_seconds"),
        F.max(F.when(ok, F.col("elapsed_seconds"))).alias("max_seconds"),
        (exact_sum(F.when(ok, F.col("elapsed_seconds"))) / F.nullif(good, F.lit(0))).alias("mean_seconds"))


LENIENT_VALIDATORS = ["radiometric", "vegetation", "visual", "performance"]


def bench_verdict(runs: DataFrame, validations: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """PASS when every run succeeded and no counted validation failed.

    Without ``strict`` only validators that report one overall ``passed`` field count.
    """
    ok = F.col("success")
    total = runs.agg(
        F.count("*").alias("total_runs"), F.count_if(ok).alias("total_passed"),
        F.count_if(~ok).alias("total_failed"),
        F.coalesce(exact_sum("elapsed_seconds"), F.lit(0.0)).alias("total_time_seconds"))
    if validations is None:
        checked = total.withColumn("validation_passed", F.lit(True))
    else:
        counted = validations if strict else validations.where(F.col("validator").isin(LENIENT_VALIDATORS))
        bad = counted.agg(F.count_if(~F.col("passed")).alias("_bad"))
        # both sides are one-row aggregates
        checked = (total.withColumn("_k", F.lit(0)).join(bad.withColumn("_k", F.lit(0)), "_k")
                   .withColumn("validation_passed", F.col("_bad") == 0).drop("_bad", "_k"))
    all_ok = F.col("total_failed") == 0
    return checked.withColumns({
        "all_stages_passed": all_ok,
        "verdict": F.when(all_ok & F.col("validation_passed"), "PASS").otherwise("FAIL")})


def perf_metrics(runs: DataFrame) -> DataFrame:
    """Per stage: images per minute and storage over successful runs, mean queue latency over all runs.

    Reads stage, success, elapsed_seconds, image_count, output_bytes, submit_time, start_time.
    """
    ok = F.col("success")
    images = F.coalesce(F.sum(F.when(ok, F.coalesce("image_count", F.lit(0)))), F.lit(0))
    secs = F.coalesce(exact_sum(F.when(ok, F.col("elapsed_seconds"))), F.lit(0.0))
    size = F.coalesce(F.sum(F.when(ok, F.col("output_bytes"))), F.lit(0))
    timed = F.col("submit_time").isNotNull() & F.col("start_time").isNotNull()
    return runs.groupBy("stage").agg(
        F.when((secs > 0) & (images > 0), images / secs * 60.0).alias("images_per_min"),
        F.when(secs > 0, size / (1024.0 * 1024.0) / secs).alias("storage_mb_per_s"),
        (exact_sum(F.when(timed, F.col("start_time") - F.col("submit_time")))
         / F.nullif(F.count_if(timed), F.lit(0))).alias("queue_latency"))


def scaling_efficiency(runs: DataFrame) -> DataFrame:
    """(single-GPU mean / multi-GPU mean) / n, n being the last multi-GPU count in run order."""
    r = runs.where(F.col("success") & F.col("gpu_count").isNotNull())
    single, multi = F.col("gpu_count") == 1, F.col("gpu_count") > 1
    t1 = exact_sum(F.when(single, F.col("elapsed_seconds"))) / F.nullif(F.count_if(single), F.lit(0))
    tn = exact_sum(F.when(multi, F.col("elapsed_seconds"))) / F.nullif(F.count_if(multi), F.lit(0))
    last = F.max_by(F.when(multi, F.col("gpu_count")),
                    F.when(multi, F.struct("stage_order", "run_index")))
    return r.agg(F.when(tn > 0, t1 / tn / last).alias("scaling_efficiency"), last.alias("gpu_count"))


def upload_outcome(uploads: DataFrame) -> DataFrame:
    """Per job: uploaded, failed, failed types, and whether a critical product failed."""
    bad = ~F.col("ok")
    types = F.array_sort(F.collect_set(F.when(bad, F.col("type"))))
    return uploads.groupBy("job_id").agg(
        F.count_if(~bad).alias("uploaded"), F.count_if(bad).alias("failed"),
        types.alias("failed_types"),
        F.coalesce(F.bool_or(bad & F.col("type").isin(K.CRITICAL_PRODUCTS)), F.lit(False)).alias("critical"))


def reconstruction_stats(cameras: DataFrame, images: DataFrame, observations: DataFrame) -> DataFrame:
    """Model size and quality from an observation table (point_id, image_id, error)."""
    per_point = observations.groupBy("point_id").agg(
        F.count("*").alias("n"), exact_sum("error").alias("e"))
    points = per_point.agg(F.count("*").alias("points"), F.sum("n").alias("observations"),
                           exact_sum("e").alias("err"))
    seen = observations.groupBy("image_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("registered"))
    k = F.lit(0).alias("_k")
    n_cam = cameras.agg(F.count("*").alias("cameras")).withColumn("_k", k)
    n_img = images.agg(F.count("*").alias("images")).withColumn("_k", k)
    # joins of one-row aggregates
    return (points.withColumn("_k", k).join(seen.withColumn("_k", k), "_k").join(n_cam, "_k").join(n_img, "_k")
            .select("cameras", "images", "registered", "points",
                    (F.col("observations") / F.nullif(F.col("points"), F.lit(0))).alias("mean_track_length"),
                    (F.col("observations") / F.nullif(F.col("registered"), F.lit(0))).alias("mean_observations"),
                    (F.col("err") / F.nullif(F.col("observations"), F.lit(0))).alias("mean_error")))


def dense_sparse_ratio(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    both = dense.select(F.lit(1).alias("d")).unionByName(sparse.select(F.lit(0).alias("d")))
    n_d = F.count_if(F.col("d") == 1)
    n_s = F.count_if(F.col("d") == 0)
    return both.agg(n_d.alias("dense_points"), n_s.alias("sparse_points"),
                    (n_d / F.nullif(n_s, F.lit(0))).alias("ratio"))


def downsample_stats(results: DataFrame) -> DataFrame:
    """Reads ok, bytes_before, bytes_after."""
    ok = F.col("ok")
    before = F.sum(F.when(ok, F.col("bytes_before")))
    after = F.sum(F.when(ok, F.col("bytes_after")))
    return results.agg(
        F.count_if(ok).alias("processed"), F.count_if(~ok).alias("failed"),
        F.coalesce(F.when(before > 0, (1 - after / before) * 100.0), F.lit(0.0)).alias("reduction_pct"))
