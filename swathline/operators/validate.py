"""Accuracy and quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathline.operators.grid import LINE, clean, finite
from swathline.operators.neighbours import SIDES, stencil
from swathline.operators.relations import gcp_match
from swathline.operators.terrain import laplacian, sobel, sobel_x, sobel_y

RGB = ["red", "green", "blue"]


def checkpoint_rmse(gcp: DataFrame, est: DataFrame, h: float = 0.10, v: float = 0.15) -> DataFrame:
    """One row: horizontal and vertical RMSE of the matched points against their limits.

    No match at all: infinite horizontal error, which fails; no height to compare: NULL, which passes.
    """
    m = gcp_match(gcp, est)
    dx, dy, dz = (F.col(f"est_{c}") - F.col(c) for c in "xyz")
    agg = m.agg(F.count("*").alias("matched"), F.sqrt(F.avg(dx * dx + dy * dy)).alias("_h"),
                F.sqrt(F.avg(dz * dz)).alias("rmse_vertical"))
    out = agg.withColumn("rmse_horizontal", F.coalesce("_h", F.lit(float("inf")))).drop("_h")
    return out.withColumns({
        "passed_horizontal": F.col("rmse_horizontal") <= h,
        "passed_vertical": F.coalesce(F.col("rmse_vertical") <= v, F.lit(True))})


def _skill(pairs: DataFrame) -> DataFrame:
    """1 - SSres / SStot per band and pooled ('overall'), from one pass of moments about the reference mean."""
    ref, got = F.col("reference"), F.col("measured")
    sums = pairs.rollup("band").agg(
        F.count("*").alias("n"), F.sum((ref - got) * (ref - got)).alias("res"),
        (F.var_pop("reference") * F.count("*")).alias("tot"),
        (F.max("reference") == F.min("reference")).alias("_flat"))
    flat = F.coalesce(F.col("_flat"), F.lit(False))
    r2 = (F.when(F.col("n") < 2, 0.0)
          .when(flat, F.when(F.col("res") == 0, 1.0).otherwise(0.0))
          .otherwise(1 - F.col("res") / F.col("tot")))
    return sums.select(F.coalesce("band", F.lit("overall")).alias("band"), "n", r2.alias("r2"))


def r2_skill(pairs: DataFrame, threshold: float, finite_only: bool = False) -> DataFrame:
    """Skill per band and pooled (band 'overall'); ``pairs`` has band, reference, measured."""
    if finite_only:
        pairs = pairs.where(finite(F.col("reference")) & finite(F.col("measured")))
    # NaN sorts above every number, so it has to be told apart
    return _skill(pairs).withColumn("passed", ~F.isnan("r2") & (F.col("r2") >= threshold))


def index_sample(raster: DataFrame, n: int = 10000, seed: int = 42) -> DataFrame:
    """A repeatable sample of index values within [-1, 1], drawn by the digest of the seed and the cell.

    The same cells come out on any cluster and partitioning; each task passes on its n lowest digests only.
    """
    ok = raster.where(F.col("value").between(-1, 1))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in (*LINE, "row", "col")]))
    return ok.orderBy(key, *LINE, "row", "col").limit(n)


def gsd_check(runs: DataFrame, target: float | Column, tol: float = 0.05) -> DataFrame:
    """Relative deviation of the measured ground distance (cm) from the target.

    Measured: ``gsd``, else ``resolution_m`` in cm, else the pixel size in cm.
    """
    goal = target if isinstance(target, Column) else F.lit(float(target))
    got = F.coalesce("gsd", F.col("resolution_m") * 100, F.col("pixel_size_m") * 100)
    out = runs.withColumn("measured_gsd", got).withColumn("deviation", F.abs(F.col("measured_gsd") - goal) / goal)
    return out.withColumn("gsd_passed", F.coalesce(F.col("deviation") <= tol, F.lit(False)))


def reproducibility(pixels: DataFrame, threshold: float = 0.99) -> DataFrame:
    """Mean Pearson correlation over all pairs of runs, per group, without making the pairs.

    ``pixels``: group_id, run_id, ordinal (0-based pixel number), value.  For runs cut to one length the
    correlations of all pairs add up to half of (square of the summed z-scores - sum of squared z-scores),
    so a pixel needs only the sum over its runs.  A pair is cut to its shorter run: for each distinct
    length L, pairs among runs of at least L, less pairs among strictly longer ones.  A constant run
    scores 1 against an equal constant run and 0 otherwise.  A value that is nodata or not finite counts as the mean of its run.
    """
    pixels = clean(pixels)
    runs = pixels.groupBy("group_id", "run_id").agg(F.count("*").alias("len"))
    lengths = runs.groupBy("group_id").agg(F.array_sort(F.collect_set("len")).alias("lengths"))
    tagged = (pixels.join(runs, ["group_id", "run_id"]).join(lengths, "group_id")
              .withColumn("cut", F.explode(F.filter("lengths", lambda c: (c <= F.col("len")) & (c > F.col("ordinal")))))
              .drop("lengths"))
    per_run = tagged.groupBy("group_id", "cut", "run_id").agg(
        F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"),
        F.min("value").alias("lo"), F.max("value").alias("hi"))
    z_all = (tagged.join(per_run, ["group_id", "cut", "run_id"])
             .withColumn("z", F.when(F.col("hi") > F.col("lo"), F.coalesce((F.col("value") - F.col("m")) / F.col("sd"), F.lit(0.0))).otherwise(0.0))
             .withColumn("zl", F.when(F.col("len") > F.col("cut"), F.col("z")).otherwise(0.0)))
    per_pixel = z_all.groupBy("group_id", "cut", "ordinal").agg(
        F.sum("z").alias("s"), F.sum(F.col("z") * F.col("z")).alias("q"),
        F.sum("zl").alias("sl"), F.sum(F.col("zl") * F.col("zl")).alias("ql"))
    pair_sum = (F.sum(F.col("s") * F.col("s") - F.col("q")) - F.sum(F.col("sl") * F.col("sl") - F.col("ql"))) / 2
    varying = per_pixel.groupBy("group_id", "cut").agg((pair_sum / F.first("cut")).alias("corr_sum"))
    # constant runs: equal constants pair up to 1, counted by value
    longer = per_run.join(runs, ["group_id", "run_id"]).withColumn("longer", (F.col("len") > F.col("cut")).cast("long"))
    same = (longer.where("hi = lo").groupBy("group_id", "cut", "lo").agg(F.count("*").alias("k"), F.sum("longer").alias("kl"))
            .withColumn("p", (F.col("k") * (F.col("k") - 1) - F.col("kl") * (F.col("kl") - 1)) / 2)
            .groupBy("group_id", "cut").agg(F.sum("p").alias("equal_pairs")))
    total = varying.join(same, ["group_id", "cut"], "left").groupBy("group_id").agg(
        F.sum(F.col("corr_sum") + F.coalesce("equal_pairs", F.lit(0.0))).alias("total"))
    n = runs.groupBy("group_id").agg(F.count("*").alias("runs"))
    out = n.join(total, "group_id").withColumn("pairs", (F.col("runs") * (F.col("runs") - 1) / 2).cast("long"))
    out = out.withColumn("correlation", F.when(F.col("pairs") > 0, F.col("total") / F.col("pairs")))
    return out.select("group_id", "runs", "pairs", "correlation",
                      F.coalesce(~F.isnan("correlation") & (F.col("correlation") >= threshold), F.lit(False)).alias("reproducible"))


def grey(raster: DataFrame) -> DataFrame:
    """One grey value per pixel (0 for nodata): weighted colours where there are three, else the band."""

    def pick(b: str) -> Column:
        return F.max(F.when(F.col("band") == b, F.coalesce("value", F.lit(0.0))))

    px = clean(raster).groupBy("raster_id", "row", "col").agg(
        *[pick(b).alias(b) for b in RGB], F.max(F.coalesce("value", F.lit(0.0))).alias("any"))
    mixed = F.round(0.299 * F.col("red") + 0.587 * F.col("green") + 0.114 * F.col("blue"))
    return px.select("raster_id", F.lit("grey").alias("band"), "row", "col", F.coalesce(mixed, "any").alias("value"))


def stretched(raster: DataFrame) -> DataFrame:
    """Grey values brought to whole numbers 0..255 between the raster's extremes."""
    g = grey(raster)
    span = g.groupBy("raster_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    scaled = F.floor((F.col("value") - F.col("lo")) * 255 / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)))
    return g.join(span, "raster_id").select("raster_id", "band", "row", "col",
                                            F.coalesce(scaled, F.lit(0)).cast("double").alias("value"))


def visual_coverage(raster: DataFrame) -> DataFrame:
    share = F.avg((F.col("value") != 0).cast("double"))
    return grey(raster).groupBy("raster_id").agg(share.alias("coverage")).withColumn(
        "flagged", F.col("coverage") < 0.5)


def visual_blur(raster: DataFrame) -> DataFrame:
    sharp = F.least(F.var_pop("value") / 500.0, F.lit(1.0))
    return laplacian(stretched(raster)).groupBy("raster_id").agg(sharp.alias("blur")).withColumn(
        "flagged", F.col("blur") < 0.3)


def visual_color(raster: DataFrame, min_bands: int = 3) -> DataFrame:
    """Agreement of the four corner blocks; images with fewer than ``min_bands`` bands score 1."""
    raster = clean(raster)
    size = raster.groupBy("raster_id").agg(
        (F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"), F.count_distinct("band").alias("bands"))
    # three band names at most take part in the distinct count's second step
    qh = F.greatest(F.floor(F.col("h") / 4), F.lit(1))
    qw = F.greatest(F.floor(F.col("w") / 4), F.lit(1))
    px = raster.groupBy("raster_id", "row", "col").agg(
        F.sum(F.coalesce("value", F.lit(0.0))).alias("s"), F.count("*").alias("n"), F.max("value").alias("top"))
    df = px.join(size, "raster_id")
    side_r = F.when(F.col("row") < qh, 0).when(F.col("row") >= F.col("h") - qh, 2)
    side_c = F.when(F.col("col") < qw, 0).when(F.col("col") >= F.col("w") - qw, 1)
    corner = df.where((F.col("top") > 0) & (F.col("bands") >= min_bands)).withColumn("q", side_r + side_c)
    means = corner.where("q IS NOT NULL").groupBy("raster_id", "q").agg((F.sum("s") / F.sum("n")).alias("m"))
    spread = means.groupBy("raster_id").agg(F.count("*").alias("k"), (F.max("m") - F.min("m")).alias("range"))
    score = F.when(F.col("k") >= 2, F.greatest(F.lit(0.0), 1 - F.col("range") / 128.0)).otherwise(1.0)
    return size.select("raster_id").join(spread, "raster_id", "left").select("raster_id", score.alias("color")).withColumn(
        "flagged", F.col("color") < 0.5)


def visual_seams(raster: DataFrame, weak: float = 50.0, strong: float = 150.0) -> DataFrame:
    """1 - 10 x edge share; a weak edge counts when it touches a strong one (one step, not whole chains)."""
    mag = sobel(stretched(raster)).select(*LINE, "row", "col", F.col("magnitude").alias("value"))
    near = F.greatest(*[F.coalesce(F.col(s), F.lit(0.0)) for s in SIDES])
    edge = (F.col("value") >= strong) | ((F.col("value") >= weak) & (near >= strong))
    return stencil(mag).groupBy("raster_id").agg(
        F.greatest(F.lit(0.0), 1 - 10 * F.avg(edge.cast("double"))).alias("seams")).withColumn(
        "flagged", F.col("seams") < 0.5)


def visual_qa(raster: DataFrame, threshold: float = 0.7, weak: float = 50.0, strong: float = 150.0) -> DataFrame:
    """The four scores and their mean; blur and seams come from one neighbourhood pass."""
    around = stencil(stretched(raster), border="mirror")
    lap = F.col("n") + F.col("s") + F.col("w") + F.col("e") - 4 * F.col("c")
    size = F.abs(sobel_x()) + F.abs(sobel_y())
    mag = around.select(*LINE, "row", "col", lap.alias("lap"), size.alias("value"))
    near = F.greatest(*[F.coalesce(F.col(s), F.lit(0.0)) for s in SIDES])
    edge = (F.col("value") >= strong) | ((F.col("value") >= weak) & (near >= strong))
    texture = stencil(mag, keep=("lap",)).groupBy("raster_id").agg(
        F.least(F.var_pop("lap") / 500.0, F.lit(1.0)).alias("blur"),
        F.greatest(F.lit(0.0), 1 - 10 * F.avg(edge.cast("double"))).alias("seams"))
    out = (visual_coverage(raster).drop("flagged").join(texture, "raster_id")
           .join(visual_color(raster).drop("flagged"), "raster_id"))
    score = (F.col("coverage") + F.col("blur") + F.col("color") + F.col("seams")) / 4
    return out.withColumn("score", score).withColumn("passed", F.col("score") >= threshold)
