"""Surface trends and high-frequency agreement between bands."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathline.operators.grid import clean
from swathline.operators.neighbours import box_mean


def surface_fit(raster: DataFrame, degree: int = 1) -> DataFrame:
    """Least-squares plane (1) or quadratic (2) over the valid cells of one raster: one row.

    The normal equations are sums over cells; only those sums reach the driver for a 3x3 or 6x6 solve.
    Coordinates are centred and scaled first so the sums stay well conditioned.
    """
    cells = clean(raster).where(F.col("value").isNotNull())
    span = cells.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"),
                     F.max("col").alias("c1"), F.avg("value").alias("m")).first()

    def unit(c: str, lo: int, hi: int):
        half = max((hi - lo) / 2.0, 1.0)
        return (F.col(c) - (lo + hi) / 2.0) / half

    x, y = unit("col", span["c0"], span["c1"]), unit("row", span["r0"], span["r1"])
    terms = [F.lit(1.0), x, y] + ([x * x, x * y, y * y] if degree == 2 else [])
    z = F.col("value") - span["m"]
    k = len(terms)
    sums = cells.agg(*[F.sum(terms[i] * terms[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)],
                     *[F.sum(terms[i] * z).alias(f"b{i}") for i in range(k)]).first()
    a = np.array([[sums[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    coef = np.linalg.solve(a, np.array([sums[f"b{i}"] for i in range(k)]))
    fit = F.lit(0.0)
    for c, t in zip(coef, terms):
        fit = fit + float(c) * t
    res = z - fit
    return cells.agg(F.count("*").alias("cells"),
                     (1 - F.sum(res * res) / F.sum(z * z)).alias("explained"),
                     F.sqrt(F.avg(res * res)).alias("residual_std"))


def highpass_corr(raster: DataFrame, a: str, b: str, box: int = 15) -> DataFrame:
    """Correlation of two bands after taking away a moving mean, and each residual's spread over its mean."""
    flat = box_mean(raster.where(F.col("band").isin(a, b)), box)
    res = flat.where(F.col("value").isNotNull()).withColumn("res", F.col("value") - F.col("box"))
    per = res.groupBy("raster_id", "row", "col").agg(*[
        F.max(F.when(F.col("band") == n, F.col(c))).alias(f"{c}_{k}")
        for k, n in (("a", a), ("b", b)) for c in ("res", "value")])
    both = per.where("res_a IS NOT NULL AND res_b IS NOT NULL")
    return both.groupBy("raster_id").agg(
        F.corr("res_a", "res_b").alias("corr"),
        (F.stddev_pop("res_a") / F.nullif(F.avg("value_a"), F.lit(0.0))).alias("noise_a"),
        (F.stddev_pop("res_b") / F.nullif(F.avg("value_b"), F.lit(0.0))).alias("noise_b"))
