"""Sorting, paging and newest-first lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

JOB_ORDERINGS = ["created_at", "-created_at", "progress", "-progress", "status", "-status"]


def order_whitelist(df: DataFrame, ordering: str | None, allowed: Sequence[str] = JOB_ORDERINGS,
                    default: str = "-created_at", tie: Sequence[str] = ("job_id",)) -> DataFrame:
    """Sort by a listed field (``-`` for descending), else by the default; ids break ties."""
    chosen = ordering if ordering in allowed else default
    name = chosen.lstrip("-")
    main = F.desc(name) if chosen.startswith("-") else F.asc(name)
    return df.orderBy(main, *[F.asc(t) for t in tie])


def paginate(df: DataFrame, page: int = 1, page_size: int = 20, cap: int | None = 100) -> DataFrame:
    """One page of an ordered DataFrame, with the total and whether there are neighbours.

    Sort and limit become one top-k step; the total is a count that does not sort.
    """
    size = min(page_size, cap) if cap else page_size
    start = (page - 1) * size
    total = df.agg(F.count(F.lit(1)).alias("total")).withColumn("_k", F.lit(0))
    rows = df.offset(start).limit(size).withColumn("_k", F.lit(0))
    return (rows.join(F.broadcast(total), "_k").drop("_k")  # total is one row
            .withColumns({"has_next": F.col("total") > start + size, "has_previous": F.lit(page > 1)}))


def recent_activity(datasets: DataFrame, jobs: DataFrame, limit: int = 20) -> DataFrame:
    """The newest datasets and jobs merged, newest first."""
    d = (datasets.select(F.lit("dataset").alias("kind"), F.col("dataset_id").alias("id"), "created_at")
         .orderBy(F.desc("created_at"), "id").limit(limit))
    j = (jobs.select(F.lit("job").alias("kind"), F.col("job_id").alias("id"), "created_at")
         .orderBy(F.desc("created_at"), "id").limit(limit))
    return d.unionByName(j).orderBy(F.desc("created_at"), "kind", "id").limit(limit)


def top1_product_run(results: DataFrame) -> DataFrame:
    """Newest result per dataset."""
    names = [c for c in results.columns if c not in ("dataset_id", "created_at")]
    rec = F.struct("created_at", *names)
    return results.groupBy("dataset_id").agg(F.max(rec).alias("r")).select("dataset_id", "r.*")
