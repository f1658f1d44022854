"""Row filters and derived columns over jobs, products, datasets and uploads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathline.functions import constants as K
from swathline.functions.scalars import lookup


def _listed(text: str | Sequence[str] | None) -> list[str]:
    if text is None:
        return []
    parts = text.split(",") if isinstance(text, str) else text
    return [p.strip() for p in parts]


def _contains(col: str, text: str) -> Column:
    return F.lower(F.col(col).cast("string")).contains(text.lower())


def _whole(value: object) -> int | None:
    try:
        return int(value)
    except (TypeError, ValueError):
        return None


def _moment(text: str) -> Column:
    """ISO time in UTC as a zone-free timestamp; NULL when it cannot be read."""
    iso = F.lit(text.replace("Z", "+00:00"))
    return F.to_utc_timestamp(
        F.try_to_timestamp(iso), F.current_timezone()).cast("timestamp_ntz")


def _between(df: DataFrame, col: str, after: str | None, before: str | None) -> DataFrame:
    """Inclusive range; a bound that is not a time is ignored."""
    if after:
        bound = _moment(after)
        df = df.where(bound.isNull() | (F.col(col) >= bound))
    if before:
        bound = _moment(before)
        df = df.where(bound.isNull() | (F.col(col) <= bound))
    return df


def job_dataset(jobs: DataFrame, datasets: DataFrame) -> DataFrame:
    """Jobs with their dataset's organisation and name, 'Unknown' where there is none."""
    dim = datasets.select(F.col("dataset_id"), "org_id", F.col("name").alias("_name"))
    return (jobs.join(dim, "dataset_id", "left")
            .withColumn("dataset_name", F.coalesce("_name", F.lit("Unknown"))).drop("_name"))


def product_dataset(products: DataFrame, datasets: DataFrame, jobs: DataFrame) -> DataFrame:
    dim = datasets.select("dataset_id", "org_id", F.col("name").alias("_name"))
    job = jobs.select("job_id", F.col("status").alias("job_status"))
    return (products.join(dim, "dataset_id", "left").join(job, "job_id", "left")
            .withColumn("dataset_name", F.coalesce("_name", F.lit("Unknown"))).drop("_name"))


def org_scope(df: DataFrame, datasets: DataFrame, org: int) -> DataFrame:
    """Rows whose dataset belongs to the organisation."""
    mine = datasets.where(F.col("org_id") == org).select("dataset_id")
    return df.join(mine, "dataset_id", "left_semi")


def job_filter(jobs: DataFrame, datasets: DataFrame, org: int, status=None, stage=None, dataset=None,
               progress_min=None, progress_max=None, after: str | None = None, before: str | None = None,
               search: str | None = None) -> DataFrame:
    df = jobs
    if status:
        df = df.where(F.col("status").isin(_listed(status)))
    if stage:
        df = df.where(F.col("stage").isin(_listed(stage)))
    if dataset is not None:
        df = df.where(F.col("dataset_id") == dataset)
    if _whole(progress_min) is not None:
        df = df.where(F.col("progress") >= _whole(progress_min))
    if _whole(progress_max) is not None:
        df = df.where(F.col("progress") <= _whole(progress_max))
    df = _between(df, "created_at", after, before)
    mine = datasets.where(F.col("org_id") == org)
    joined = job_dataset(df, mine).where(F.col("org_id").isNotNull())
    if search:
        joined = joined.where(_contains("dataset_name", search) | _contains("job_id", search))
    return joined


def product_filter(products: DataFrame, datasets: DataFrame, org: int, dataset=None, job=None, type=None,
                   after: str | None = None, before: str | None = None) -> DataFrame:
    df = products
    for col, wanted in (("dataset_id", dataset), ("job_id", job), ("type", type)):
        if wanted is not None:
            df = df.where(F.col(col) == wanted)
    return org_scope(_between(df, "created_at", after, before), datasets, org)


def dataset_filter(datasets: DataFrame, images: DataFrame, org: int, search: str | None = None,
                   platform=None, status=None, created: tuple[str | None, str | None] = (None, None),
                   captured: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """Datasets of one organisation with their derived status; the status test follows the aggregate."""
    from swathline.operators.aggregates import dataset_status

    df = datasets.where(F.col("org_id") == org)
    if search:
        df = df.where(_contains("name", search) | _contains("notes", search))
    wanted = _listed(platform)
    if wanted:
        any_of = _contains("platform", wanted[0])
        for p in wanted[1:]:
            any_of = any_of | _contains("platform", p)
        df = df.where(any_of)
    df = _between(df, "created_at", *created)
    df = _between(df, "capture_start", *captured)
    out = dataset_status(df, images.join(df.select("dataset_id").distinct(), "dataset_id", "left_semi"))
    states = [s.upper() for s in _listed(status)]
    return out.where(F.col("status").isin(states)) if states else out


def upload_filter(images: DataFrame, user: int, dataset=None, batch=None, file_type=None) -> DataFrame:
    df = images.where(F.col("user_id") == user)
    for col, wanted in (("dataset_id", dataset), ("batch_id", batch), ("file_type", file_type)):
        if wanted is not None:
            df = df.where(F.col(col) == wanted)
    return df.orderBy(F.desc("created_at"), "image_id")


def org_list(orgs: DataFrame, user: int, equals: Mapping[str, object] | None = None,
             order_by: str | None = None) -> DataFrame:
    """Organisations a user belongs to, matched exactly on any given field."""
    df = orgs.where(F.col("user_id") == user)
    for col, value in (equals or {}).items():
        df = df.where(F.col(col) == value)
    if order_by:
        name = order_by.lstrip("-")
        df = df.orderBy(F.desc(name) if order_by.startswith("-") else F.asc(name))
    return df


def product_category(df: DataFrame) -> DataFrame:
    table = {t: c for c, types in K.PRODUCT_CATEGORIES.items() for t in types}
    return df.withColumn("category", lookup(F.col("type"), table, F.lit("Other")))


def product_display(df: DataFrame) -> DataFrame:
    return df.withColumn("type_display", lookup(F.col("type"), K.PRODUCT_LABELS, F.col("type")))


def seconds_between(end: Column, start: Column) -> Column:
    """Elapsed seconds with the fraction; as an interval, so the session's time zone plays no part."""
    return (end - start).cast("interval second").cast("decimal(20,6)").cast("double")


def job_duration(jobs: DataFrame, detail: bool = False) -> DataFrame:
    done = F.col("status").isin("completed", "failed")
    start = F.coalesce("started_at", "created_at")
    if not detail:
        end = F.coalesce("completed_at", "updated_at")
        whole = seconds_between(end, start).cast("long")
        return jobs.withColumn("duration_seconds", F.when(done, whole))
    end = F.coalesce(F.when(done, F.col("completed_at")), F.col("updated_at"))
    df = jobs.withColumn("duration_seconds", seconds_between(end, start).cast("long"))
    s = F.col("duration_seconds")
    rest = F.pmod(s, F.lit(3600))
    return df.withColumn("duration_text", F.format_string(
        "%dh %dm %ds", F.floor(s / 3600), F.floor(rest / 60), F.pmod(s, F.lit(60))))


def retry_eligible(jobs: DataFrame, max_retries: int = 3) -> DataFrame:
    ok = (F.col("status").isin("failed", "cancelled") & F.col("can_retry")
          & (F.col("retry_count") < max_retries))
    resume = F.when(ok & ~F.col("stage").isin("queued", "completed") & (F.col("stage") != ""), F.col("stage"))
    return jobs.withColumns({"retry_ok": ok, "resume_stage": resume})


def cancel_eligible(jobs: DataFrame) -> DataFrame:
    return jobs.where(~F.col("status").isin(K.TERMINAL))


def delete_eligible_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status") != "processing")


def delete_eligible(datasets: DataFrame, jobs: DataFrame) -> DataFrame:
    """Datasets without a pending or processing job."""
    busy = jobs.where(F.col("status").isin("pending", "processing")).select("dataset_id")
    return datasets.join(busy, "dataset_id", "left_anti")


def job_validate(requests: DataFrame, datasets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a reason)."""
    known = datasets.select("dataset_id", F.lit(True).alias("_known")).dropDuplicates(["dataset_id"])
    size = F.coalesce(F.col("resolution_gsd") > 0, F.lit(False))
    mode = F.coalesce(F.col("analysis_mode").isin("fast", "full"), F.lit(False))
    reason = (F.when(~size, "resolution").when(~mode, "mode").when(F.col("_known").isNull(), "dataset"))
    checked = requests.join(known, "dataset_id", "left").withColumn("reason", reason).drop("_known")
    return checked.where("reason IS NULL").drop("reason"), checked.where("reason IS NOT NULL")


def next_stage(stage: Column, skipped: Column | None = None, skip_calibration: bool = False) -> Column:
    """Stage after ``stage``, passing over skipped ones; NULL after the last or for an unknown one."""
    order = [s for s in K.STAGE_ORDER if not (skip_calibration and s == "radiometric_calibration")]
    steps = F.array(*[F.lit(s) for s in order])
    here = F.array_position(steps, stage)
    later = F.when(here > 0, F.slice(steps, here.cast("int") + 1, F.lit(len(order))))
    if skipped is not None:
        later = F.filter(later, lambda s: ~F.array_contains(skipped, s))
    return F.get(later, F.lit(0))


def stage_progress(jobs: DataFrame, skip_calibration: bool = False) -> DataFrame:
    skipped = F.col("skipped") if "skipped" in jobs.columns else None
    return jobs.withColumns({
        "stage_percent": lookup(F.col("stage"), K.STAGE_PROGRESS, F.lit(0.0)),
        "next_stage": next_stage(F.col("stage"), skipped, skip_calibration),
    })


def gsd_settings(req: DataFrame, base_gsd: float = 2.5, base_size: int = 5280) -> DataFrame:
    """Image-size and output-resolution settings; ``fast`` mode works at twice the ground distance."""
    gsd = F.col("resolution_gsd")
    used = F.when(F.col("analysis_mode") == "fast", gsd * 2).otherwise(gsd)
    df = req.withColumn("effective_gsd", F.when(gsd > 0, used))
    size = F.floor(F.lit(float(base_size)) * (F.lit(base_gsd) / F.col("effective_gsd")))
    return df.withColumns({
        "max_image_size": F.when(gsd > 0, F.greatest(F.lit(640), F.least(F.lit(8192), size)))
        .otherwise(F.lit(base_size)).cast("long"),
        "ortho_resolution_m": F.when(gsd > 0, gsd / 100.0),
    })


def downsample_factor(df: DataFrame) -> DataFrame:
    """Reads width, height, current_gsd, target_gsd."""
    ratio = F.col("current_gsd") / F.col("target_gsd")
    factor = (F.when(F.col("target_gsd") <= F.col("current_gsd"), F.lit(1.0))
              .otherwise(F.greatest(F.lit(0.1), F.least(F.lit(1.0), ratio))))
    out = df.withColumn("factor", factor)
    return out.withColumns({
        "new_width": (F.col("width") * F.col("factor")).cast("long"),
        "new_height": (F.col("height") * F.col("factor")).cast("long"),
    })


def expected_product_flags(df: DataFrame) -> DataFrame:
    """Reads type and job_status."""
    return df.withColumns({
        "job_active": F.coalesce(F.col("job_status").isin(K.ACTIVE_STATUSES), F.lit(False)),
        "is_multispectral": F.col("type").isin(K.MULTISPECTRAL_PRODUCTS),
        "is_viewable": ~F.col("type").isin(K.DOWNLOAD_ONLY_PRODUCTS),
    })
