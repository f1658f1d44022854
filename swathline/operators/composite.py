"""Flight strips, shared gains and mosaics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swathline.functions import constants as K
from swathline.functions.ranking import exact_quantiles
from swathline.operators.grid import clean
from swathline.operators.neighbours import valid_weights
from swathline.session import cut

SLOT_M = 0.05


def flight_strips(captures: DataFrame, k: float = 6.0, min_gap_m: float = 5.0) -> DataFrame:
    """Strip number of each capture (flight, capture_id, lat, lon) across the flight direction.

    The cross-track axis is the minor axis of the positions' 2x2 covariance, solved in closed form, with its
    larger part made positive.  Positions fall into 5 cm slots along it.  Gaps inside a slot come from a
    window over that slot, gaps between slots from one row per slot, so a long flight is never sorted in
    one task.  A strip ends where a gap exceeds both ``min_gap_m`` and k times the flight's median gap;
    such a gap always lies between slots, so strips are numbered on the slot rows.
    """
    if min_gap_m < SLOT_M:
        raise ValueError(f"min_gap_m must be at least {SLOT_M}: nearer positions share a slot")
    m = K.METRES_PER_DEGREE
    base = captures.groupBy("flight").agg(
        F.count("*").alias("_count"), F.avg("lat").alias("_mlat"), F.avg("lon").alias("_mlon"),
        F.var_pop("lat").alias("_va"), F.var_pop("lon").alias("_vo"), F.covar_pop("lat", "lon").alias("_cov"))
    base = base.withColumn("_cos", F.cos(F.radians("_mlat")))
    a, c = F.col("_va") * m * m, F.col("_vo") * m * m * F.col("_cos") * F.col("_cos")
    b = F.col("_cov") * m * m * F.col("_cos")
    small = (a + c) / 2 - F.sqrt((a - c) * (a - c) / 4 + b * b)
    base = base.withColumns({"_a": a, "_b": b, "_c": c}).withColumn("_small", small)
    diagonal = F.abs("_b") <= 1e-12 * F.greatest(F.col("_a"), F.col("_c"))
    vx = F.when(diagonal, (F.col("_a") < F.col("_c")).cast("double")).otherwise(F.col("_b"))
    vy = F.when(diagonal, (F.col("_a") >= F.col("_c")).cast("double")).otherwise(F.col("_small") - F.col("_a"))
    base = base.withColumns({"_vx": vx, "_vy": vy})
    length = F.sqrt(F.col("_vx") * F.col("_vx") + F.col("_vy") * F.col("_vy"))
    sign = F.when(F.abs("_vx") >= F.abs("_vy"), F.signum("_vx")).otherwise(F.signum("_vy"))
    axis = base.select("flight", "_count", "_mlat", "_mlon", "_cos",
                       (F.col("_vx") * sign / length).alias("_ux"), (F.col("_vy") * sign / length).alias("_uy"))
    axis = cut(axis)  # one row per flight, read by both branches below
    placed = captures.join(axis, "flight").withColumn(
        "proj", (F.col("lat") - F.col("_mlat")) * m * F.col("_ux")
        + (F.col("lon") - F.col("_mlon")) * m * F.col("_cos") * F.col("_uy"))
    placed = placed.withColumn("slot", F.floor(F.col("proj") / SLOT_M))

    distinct = placed.groupBy("flight", "slot", "proj").agg(F.count("*").alias("n"))
    inside = W.partitionBy("flight", "slot").orderBy("proj")
    inner_gaps = distinct.withColumn("gap", F.col("proj") - F.lag("proj").over(inside))
    slots = placed.groupBy("flight", "slot").agg(F.min("proj").alias("first"), F.max("proj").alias("last"))
    line = W.partitionBy("flight").orderBy("slot")
    slots = slots.withColumn("gap", F.col("first") - F.lag("last").over(line))
    zero_gaps = distinct.where("n > 1").select("flight", F.lit(0.0).alias("gap"), (F.col("n") - 1).alias("times"))
    gaps = (inner_gaps.where("gap IS NOT NULL").select("flight", "gap", F.lit(1).cast("long").alias("times"))
            .unionByName(slots.where("gap IS NOT NULL").select("flight", "gap", F.lit(1).cast("long").alias("times")))
            .unionByName(zero_gaps))
    typical = exact_quantiles(gaps, ["flight"], "gap", {"typical": 0.5}, weight="times")
    limit = F.greatest(F.col("typical") * k, F.lit(min_gap_m))
    marked = slots.join(typical, "flight", "left").withColumn(
        "_cut", F.coalesce((F.col("gap") > limit).cast("int"), F.lit(0)))
    numbered = marked.withColumn("strip", F.sum("_cut").over(
        line.rowsBetween(W.unboundedPreceding, W.currentRow))).select("flight", "slot", "strip")
    return placed.join(numbered, ["flight", "slot"]).select(*captures.columns, "proj", "strip")


def strip_gain(means: DataFrame, strips: DataFrame) -> DataFrame:
    """One gain per image, shared by its bands.

    ``means``: flight, image_id, band, mean.  ``strips``: flight, image_id, strip.
    """
    positive = means.where(F.col("mean") > 0)
    whole = positive.groupBy("flight", "band").agg(F.avg("mean").alias("g"))
    lum = (positive.join(whole, ["flight", "band"]).groupBy("flight", "image_id")
           .agg(F.avg(F.col("mean") / F.col("g")).alias("lum")))
    lit = strips.join(lum, ["flight", "image_id"])
    per_strip = lit.groupBy("flight", "strip").agg(F.avg("lum").alias("strip_mean"))
    # strips of a flight are few: they are at least 5 m apart
    target = per_strip.groupBy("flight").agg(F.percentile("strip_mean", 0.5).alias("target"))
    count = strips.groupBy("flight", "strip").agg(F.count("*").alias("n")).groupBy("flight").agg(
        F.count("*").alias("n_strips"), F.sum("n").alias("n_images"))
    out = (strips.join(per_strip, ["flight", "strip"], "left").join(target, "flight", "left").join(count, "flight"))
    usable = (F.col("n_strips") >= 2) & (F.col("n_images") >= 2) & (F.col("strip_mean") > 0)
    gain = F.when(usable, F.col("target") / F.col("strip_mean"))
    return out.select("flight", "image_id", "strip", F.coalesce(gain, F.lit(1.0)).alias("gain"))


def feather_composite(raster: DataFrame, gains: DataFrame, mask: DataFrame | None = None,
                      weights: DataFrame | None = None) -> DataFrame:
    """Weighted mean of overlapping warped images per band and cell.

    ``raster``: raster_id (image), band, row, col, value on the common grid.  ``gains``: raster_id, gain.
    """
    if weights is None:
        df = valid_weights(raster)
    else:
        df = raster.where(F.col("value").isNotNull()).join(weights, ["raster_id", "band", "row", "col"])
    df = df.join(gains, "raster_id", "left")
    lit = F.col("value") * F.coalesce("gain", F.lit(1.0))
    out = df.groupBy("band", "row", "col").agg(
        F.sum(lit * F.col("weight")).alias("_s"), F.sum("weight").alias("_w"))
    out = out.select("band", "row", "col", F.when(F.col("_w") > 0, F.col("_s") / F.col("_w")).alias("value"))
    if mask is not None:
        out = out.join(mask.select("row", "col"), ["row", "col"], "left_semi")
    return out


def median_composite(raster: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """Median of the overlapping images per band and cell, in two counting passes: no task holds a cell's values."""
    out = exact_quantiles(clean(raster), ["band", "row", "col"], "value", {"value": 0.5})
    if mask is not None:
        out = out.join(mask.select("row", "col"), ["row", "col"], "left_semi")
    return out
