"""Band stacks, vegetation indices, pyramids and raster statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathline.functions import constants as K
from swathline.functions.ranking import exact_quantiles
from swathline.operators.grid import LINE, clean

PIXEL = ["raster_id", "row", "col"]
TINY = 1e-10


def _bands(raster: DataFrame, bands: Sequence[str]) -> DataFrame:
    """One row per pixel with a column per band: a single grouping on the pixel.

    Pixels of other bands count too, so a capture that lacks a band keeps its pixels, as nodata.
    """
    return clean(raster).groupBy(*PIXEL).agg(
        *[F.max(F.when(F.col("band") == b, F.col("value"))).alias(b) for b in bands])


def stack_bands(raster: DataFrame, bands: Sequence[str] | None = None) -> DataFrame:
    """Pixels with the present bands as columns in stacking order; an error when there is none."""
    if bands is None:
        listed = F.collect_set(F.when(F.col("band").isin(K.SPECTRAL_BANDS), F.col("band")))
        have = raster.agg(listed.alias("b")).first()["b"]  # at most the five spectral band names
        bands = [b for b in K.SPECTRAL_BANDS if b in have]
    if not bands:
        raise ValueError("no spectral band to stack")
    return _bands(raster, bands)


def pair_pixels(raster: DataFrame, a: str, b: str) -> DataFrame:
    """Two bands on the same pixel; nodata in either makes both nodata."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return _bands(raster, [a, b]).select(
        *PIXEL, F.when(both, F.col(a)).alias("a"), F.when(both, F.col(b)).alias("b"))


def difference_ratio(a: Column, b: Column, mode: str = "production") -> Column:
    """(a - b) / (a + b) with one of three rules for a zero denominator."""
    total = a + b
    if mode == "validation":
        return F.when(total == 0, F.lit(float("nan"))).otherwise((a - b) / total)
    if mode == "calibrator":
        ratio = (a - b) / (total + TINY)
    elif mode == "production":
        ratio = (a - b) / F.when(total == 0, F.lit(TINY)).otherwise(total)
    else:
        raise ValueError(f"unknown mode {mode}")
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio))


def normalised_difference(raster: DataFrame, index: str = "ndvi", mode: str = "production") -> DataFrame:
    """NDVI, NDRE or GNDVI as a raster whose band is the index name; nodata where either band is."""
    a, b = K.INDEX_DEFS[index]
    value = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(),
                   difference_ratio(F.col("a"), F.col("b"), mode))
    return pair_pixels(raster, a, b).select("raster_id", F.lit(index).alias("band"), "row", "col",
                                            value.alias("value"))


def all_indices(raster: DataFrame, mode: str = "production") -> DataFrame:
    """Every index from one grouping of the pixels, as rasters named by the index."""
    px = _bands(raster, sorted({b for pair in K.INDEX_DEFS.values() for b in pair}))
    made = F.array(*[F.struct(F.lit(n).alias("band"), F.when(
        F.col(a).isNotNull() & F.col(b).isNotNull(), difference_ratio(F.col(a), F.col(b), mode)).alias("value"))
        for n, (a, b) in K.INDEX_DEFS.items()])
    return px.select(*PIXEL, F.inline(made)).select(*LINE, "row", "col", "value")


def available_indices(raster: DataFrame) -> DataFrame:
    """Which indices each raster can give: both bands of an index must be present."""
    have = raster.groupBy("raster_id").agg(*[
        F.coalesce(F.bool_or(F.col("band") == b), F.lit(False)).alias(b) for b in K.SPECTRAL_BANDS])
    return have.select("raster_id", *[(F.col(a) & F.col(b)).alias(n) for n, (a, b) in K.INDEX_DEFS.items()])


def stretch_u8(raster: DataFrame) -> DataFrame:
    """Valid pixels stretched to whole numbers 0..255 between the 2nd and 98th percentile; nodata becomes 0."""
    raster = clean(raster)
    q = exact_quantiles(raster, LINE, "value", {"lo": 0.02, "hi": 0.98})
    scaled = (F.col("value") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * 255
    clipped = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), scaled)))
    return raster.join(q, LINE, "left").select(
        *LINE, "row", "col", F.coalesce(F.when(scaled.isNotNull(), clipped), F.lit(0)).cast("int").alias("value"))


def image_mean(raster: DataFrame) -> DataFrame:
    """Mean of valid pixels per image and band; images with no valid pixel or mean <= 0 are dropped."""
    return (clean(raster).groupBy(*LINE).agg(F.avg("value").alias("mean"), F.count("value").alias("valid"))
            .where(F.col("mean") > 0))


def overviews(raster: DataFrame, levels: Sequence[int] = K.OVERVIEW_LEVELS) -> DataFrame:
    """Block averages of the valid pixels at each level; every level is summed from the one before."""
    out = None
    have = clean(raster).select(*LINE, "row", "col", F.col("value").alias("s"),
                         F.col("value").isNotNull().cast("long").alias("n"))
    done = 1
    for level in levels:
        if level % done:
            raise ValueError("each level must be a multiple of the one before")
        step = level // done
        have = have.groupBy(*LINE, F.floor(F.col("row") / step).cast("int").alias("row"),
                            F.floor(F.col("col") / step).cast("int").alias("col")).agg(
            F.sum("s").alias("s"), F.sum("n").alias("n"))
        done = level
        part = have.select(*LINE, F.lit(level).alias("level"), "row", "col",
                           (F.col("s") / F.nullif(F.col("n"), F.lit(0))).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def cubic_weight(t: Column) -> Column:
    """Cubic convolution kernel with a = -0.5."""
    x = F.abs(t)
    inner = (1.5 * x - 2.5) * x * x + 1.0
    outer = ((-0.5 * x + 2.5) * x - 4.0) * x + 2.0
    return F.when(x < 1, inner).when(x < 2, outer).otherwise(0.0)


def _shrink(df: DataFrame, axis: str, factor: int, size: Column) -> DataFrame:
    """Spread weighted sums along one axis onto the coarser grid."""
    at = (F.col(axis) + 0.5) / factor - 0.5
    lo = F.greatest(F.ceil(at - 2), F.lit(0))
    hi = F.least(F.floor(at + 2), F.ceil(size / factor) - 1)
    spread = df.withColumn("_at", at).withColumn(
        "_t", F.explode(F.when(lo <= hi, F.sequence(lo.cast("int"), hi.cast("int")))))
    w = cubic_weight(F.col("_at") - F.col("_t"))
    other = "col" if axis == "row" else "row"
    return (spread.withColumn("_w", w)
            .groupBy(*LINE, "factor", other, F.col("_t").alias(axis)).agg(
                F.sum(F.col("num") * F.col("_w")).alias("num"), F.sum(F.col("den") * F.col("_w")).alias("den")))


def multires(raster: DataFrame, width: int, height: int, factors: Sequence[int] = K.MULTIRES_FACTORS) -> DataFrame:
    """Cubic downsampling by each factor, columns first and then rows; nodata carries no weight."""
    base = clean(raster).where(F.col("value").isNotNull()).select(
        *LINE, "row", "col", F.col("value").alias("num"), F.lit(1.0).alias("den"))
    out = None
    for f in factors:
        df = _shrink(base.withColumn("factor", F.lit(f)), "col", f, F.lit(width))
        df = _shrink(df, "row", f, F.lit(height))
        df = df.select(*LINE, "factor", "row", "col",
                       F.when(F.abs(F.col("den")) > 1e-9, F.col("num") / F.col("den")).alias("value"))
        out = df if out is None else out.unionByName(df)
    return out


PERCENTILES = {"p1": 0.01, "p2": 0.02, "median": 0.5, "p98": 0.98, "p99": 0.99}


def raster_stats(raster: DataFrame, exact: bool = True) -> DataFrame:
    """Per raster and band: extremes, mean, population deviation, valid share and percentiles."""
    raster = clean(raster)
    base = raster.groupBy(*LINE).agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"), (F.count("value") / F.count("*") * 100).alias("valid_pct"))
    if exact:
        q = exact_quantiles(raster, LINE, "value", PERCENTILES)
    else:
        q = raster.groupBy(*LINE).agg(*[F.percentile_approx("value", p, 10000).alias(n)
                                        for n, p in PERCENTILES.items()])
    return base.join(q, LINE, "left")


def raster_histogram(raster: DataFrame, bins: int = 120) -> DataFrame:
    """Counts in equal bins between the 1st and 99th percentile; the last bin holds its upper edge."""
    raster = clean(raster)
    q = exact_quantiles(raster, LINE, "value", {"lo": 0.01, "hi": 0.99})
    v = raster.where(F.col("value").isNotNull()).join(q, LINE).where(
        F.col("value").between(F.col("lo"), F.col("hi")))
    slot = F.floor((F.col("value") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins)
    bin_no = F.least(F.coalesce(slot, F.lit(0)), F.lit(bins - 1)).cast("int")
    return v.groupBy(*LINE, bin_no.alias("bin")).agg(F.count("*").alias("n"))


def reflectance_diag(raster: DataFrame) -> DataFrame:
    """Median and 99th percentile after clipping to 0..1, and the shares that clipping touched."""
    valid = clean(raster).where(F.col("value").isNotNull())
    shares = valid.groupBy(*LINE).agg(
        F.avg((F.col("value") > 1).cast("double")).alias("clip_high"),
        F.avg((F.col("value") < 0).cast("double")).alias("clip_low"))
    clipped = valid.withColumn("value", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value"))))
    return shares.join(exact_quantiles(clipped, LINE, "value", {"median": 0.5, "p99": 0.99}), LINE)
