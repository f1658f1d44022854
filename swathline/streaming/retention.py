"""Expiry of old job rows and job state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathline.functions import constants as K


def stale_jobs(jobs: DataFrame, as_of: Column, days: int = 1) -> DataFrame:
    """Jobs not updated for more than ``days`` before ``as_of``."""
    return jobs.where(F.col("updated_at") < as_of - F.make_dt_interval(F.lit(days)))


def ttl_expiry(states: DataFrame, as_of: Column, hours: int = K.STATE_TTL_HOURS) -> DataFrame:
    """Mark each job state with when it lapses and whether it has; every write starts the time anew.

    ``states`` holds one row per write (job_id, ts); the newest write per job counts.
    """
    last = states.groupBy("job_id").agg(F.max("ts").alias("last_write"))
    return last.withColumns({
        "expires_at": F.col("last_write") + F.make_dt_interval(F.lit(0), F.lit(hours)),
        "expired": F.col("last_write") + F.make_dt_interval(F.lit(0), F.lit(hours)) <= as_of})
