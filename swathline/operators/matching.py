"""Image pairs, descriptor matches, band registration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathline.functions import constants as K
from swathline.functions.ranking import bucketed_row_number, top_per_group
from swathline.operators.grid import LINE, clean


def image_pairs(images: DataFrame, mode: str = "sequential", overlap: int = 25, quadratic: bool = True,
                radius: float | None = None) -> DataFrame:
    """Pairs of images worth matching.

    sequential: each image (flight, ordinal, image_id) with the next ``overlap`` ones and, with ``quadratic``,
    those at power-of-two steps below 2^overlap; the offsets are exploded and looked up, so pairs grow with the
    images.  spatial: images (image_id, x, y in metres) within ``radius``, met through square buckets.
    """
    if mode == "sequential":
        steps = list(range(1, overlap + 1))
        if quadratic:
            steps = sorted(set(steps) | {2 ** k for k in range(overlap)})
        ends = images.groupBy("flight").agg(F.max("ordinal").alias("_max"))
        a = images.join(ends, "flight").select(
            "flight", F.col("image_id").alias("image_a"), F.col("ordinal").alias("_o"), "_max")
        offsets = F.array(*[F.lit(s) for s in steps])
        a = a.withColumn("_step", F.explode(F.filter(offsets, lambda s: F.col("_o") + s <= F.col("_max"))))
        a = a.withColumn("ordinal", F.col("_o") + F.col("_step"))
        b = images.select("flight", "ordinal", F.col("image_id").alias("image_b"))
        return a.join(b, ["flight", "ordinal"]).select("flight", "image_a", "image_b", F.col("_step").alias("step"))
    if mode == "spatial":
        if not radius:
            raise ValueError("spatial pairs need a radius")
        side = F.lit(float(radius))
        home = images.select("image_id", "x", "y", F.floor(F.col("x") / side).alias("gx"),
                             F.floor(F.col("y") / side).alias("gy"))
        near = F.sequence(F.lit(-1), F.lit(1))
        # a few files of images can make very many pairs: deal the images over all tasks before they meet
        parts = int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        a = (home.repartition(parts, "image_id").withColumn("_i", F.explode(near)).withColumn("_j", F.explode(near))
             .select(F.col("image_id").alias("image_a"), F.col("x").alias("xa"), F.col("y").alias("ya"),
                     (F.col("gx") + F.col("_i")).alias("gx"), (F.col("gy") + F.col("_j")).alias("gy")))
        b = home.select(F.col("image_id").alias("image_b"), F.col("x").alias("xb"), F.col("y").alias("yb"), "gx", "gy")
        dx, dy = F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb")
        return (a.join(b, ["gx", "gy"]).where((F.col("image_a") < F.col("image_b")) & (dx * dx + dy * dy <= radius * radius))
                .select("image_a", "image_b", F.sqrt(dx * dx + dy * dy).alias("distance")))
    raise ValueError(f"unknown mode {mode}")


MOST_BLOCKS, LARGEST_BLOCK = 16, 16384


def _two_best(block: int):
    """Per block pair: the two nearest of block b for each descriptor of block a, as matrix products of ``block`` rows."""

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"pair": [], "side": [], "q": [], "m": [], "dot": []})
        a = np.vstack(left["vec"].to_numpy()).astype(np.float64)
        b = np.vstack(right["vec"].to_numpy()).astype(np.float64)
        ids = right["desc_id"].to_numpy()
        order = np.argsort(ids)
        b = b[order]
        found = [_first_two(a[at:at + block] @ b.T) for at in range(0, len(a), block)]
        best, dots = np.vstack([f[0] for f in found]), np.vstack([f[1] for f in found])
        rows = np.repeat(np.arange(len(a)), best.shape[1])
        cols = best.ravel()
        return pd.DataFrame({"pair": left["pair"].iloc[0], "side": left["side"].iloc[0],
                             "q": left["desc_id"].to_numpy()[rows], "m": ids[order][cols], "dot": dots.ravel()})

    return work


def _first_two(dots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the two highest of each row, ties to the first; what is not a number comes last."""
    left, rows = np.where(np.isnan(dots), -np.inf, dots), np.arange(len(dots))
    best = left.argmax(axis=1)[:, None]
    if dots.shape[1] > 1:
        left[rows, best[:, 0]] = -np.inf
        second = left.argmax(axis=1)
        # with nothing above -inf left, the first place that isn't taken
        second = np.where(second == best[:, 0], (best[:, 0] == 0).astype(second.dtype), second)
        best = np.hstack([best, second[:, None]])
    return best, dots[rows[:, None], best]


def ratio_match(descriptors: DataFrame, pairs: DataFrame, max_ratio: float = 0.75, max_distance: float = 0.65,
                cross_check: bool = True, block: int = 1024) -> DataFrame:
    """Matches between the descriptors of listed image pairs.

    ``descriptors``: image_id, desc_id, vec (unit length).  ``pairs``: image_a, image_b.  Distance is the angle.
    An image's descriptors are dealt into blocks of about ``block``, at most 16 of them, which then grow to 16384 rows: each
    descriptor goes to one task per block of the other image, so the copies stay in proportion to the input.  Each task compares
    two blocks, ``block`` rows at a time, and gives back only the two nearest per descriptor; the blocks' winners are merged by a top-2.  A descriptor is
    matched when the nearest is close enough and clearly nearer than the second, both ways when cross-checked.
    """
    n = F.count("*")
    dealt = F.least(F.ceil(n / block), F.greatest(F.lit(MOST_BLOCKS), F.ceil(n / LARGEST_BLOCK)))
    blocks = descriptors.groupBy("image_id").agg(dealt.cast("int").alias("_blocks"))
    desc = descriptors.join(blocks, "image_id").withColumn(
        "blk", F.pmod(F.xxhash64("desc_id"), F.col("_blocks")).cast("int"))
    pair = F.concat_ws("|", F.col("image_a").cast("string"), F.col("image_b").cast("string")).alias("pair")

    def way(side: str, a: str, b: str) -> Column:
        return F.struct(F.lit(side).alias("side"), F.col(a).alias("from_id"), F.col(b).alias("to_id"))

    ways = [way("ab", "image_a", "image_b")] + ([way("ba", "image_b", "image_a")] if cross_check else [])
    both = pairs.select(pair, F.inline(F.array(*ways)))
    tasks = (both.join(blocks.select(F.col("image_id").alias("from_id"), F.col("_blocks").alias("_fb")), "from_id")
             .join(blocks.select(F.col("image_id").alias("to_id"), F.col("_blocks").alias("_tb")), "to_id"))
    tasks = tasks.withColumn("fb", F.explode(F.sequence(F.lit(0), F.col("_fb") - 1))).withColumn(
        "tb", F.explode(F.sequence(F.lit(0), F.col("_tb") - 1))).drop("_fb", "_tb")
    keyed = desc.select("image_id", "blk", "desc_id", "vec")
    left = tasks.join(keyed.withColumnsRenamed({"image_id": "from_id", "blk": "fb"}), ["from_id", "fb"]).select(
        "pair", "side", "fb", "tb", "desc_id", "vec")
    right = tasks.join(keyed.withColumnsRenamed({"image_id": "to_id", "blk": "tb"}), ["to_id", "tb"]).select(
        *[F.col(c).alias(f"r_{c}") for c in ("pair", "side", "fb", "tb")], "desc_id", "vec")
    group = ["pair", "side", "fb", "tb"]
    found = left.groupBy(*group).cogroup(right.groupBy(*[f"r_{c}" for c in group])).applyInPandas(
        _two_best(block), "pair string, side string, q long, m long, dot double")
    # the two best of all blocks; Spark trims each group to two rows before the shuffle
    top = top_per_group(found, ["pair", "side", "q"], [F.desc("dot"), F.asc("m")], 2)
    rec = F.struct((-F.col("dot")).alias("d"), "m")
    merged = top.groupBy("pair", "side", "q").agg(
        F.min(rec).alias("b1"), F.when(F.count("*") > 1, F.max(rec)).alias("b2"))

    def angle(c: Column) -> Column:
        return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), -c["d"])))

    good = merged.withColumns({"d1": angle(F.col("b1")), "d2": angle(F.col("b2"))})
    good = good.where((F.col("d1") <= max_distance)
                      & (F.col("d2").isNull() | (F.col("d1") < max_ratio * F.col("d2"))))
    # both directions name the match the same way, so it counts when it is met once per direction
    forth = F.col("side") == "ab"
    met = good.select("pair", F.when(forth, F.col("q")).otherwise(F.col("b1.m")).alias("desc_a"),
                      F.when(forth, F.col("b1.m")).otherwise(F.col("q")).alias("desc_b"), "d1")
    out = met.groupBy("pair", "desc_a", "desc_b").agg(F.count("*").alias("_n"), F.max("d1").alias("distance"))
    return out.where(F.col("_n") == len(ways)).drop("_n")


def _signed_peak(surface: np.ndarray) -> tuple[int, int]:
    """Place of the highest value, counted from the origin in the shorter direction around."""
    at = np.unravel_index(surface.argmax(), surface.shape)
    return tuple(int((p + (n - 1) // 2) % n - (n - 1) // 2) for p, n in zip(at, surface.shape, strict=True))


def _phase(max_shift: int):
    def work(lines: pd.DataFrame) -> pd.DataFrame:
        """All lines of one band of one capture; each holds its columns, values and reference values.

        The planes span the image's own rows and columns, wherever on the grid it lies.
        """
        row = np.repeat(lines["row"].to_numpy(), lines["cols"].str.len())
        col = np.concatenate(lines["cols"].to_numpy())
        place = row - row.min(), col - col.min()
        planes = np.zeros((2, place[0].max() + 1, place[1].max() + 1), np.float32)
        shift = (0, 0)
        for plane, name in zip(planes, ("refs", "values"), strict=True):
            v = np.concatenate(lines[name].to_numpy()).astype(np.float64)
            good = np.isfinite(v)
            plane[place] = np.where(good, v - v[good].mean(), 0) if good.any() else 0
        if planes.any(axis=(1, 2)).all():
            fixed, moving = np.fft.rfft2(planes)
            both = fixed * moving.conj()
            both /= np.maximum(np.abs(both), np.float32(1e-12))
            found = _signed_peak(np.fft.irfft2(both, s=planes.shape[1:]))
            shift = found if max(map(abs, found)) <= max_shift else shift
        return pd.DataFrame([(lines["raster_id"].iloc[0], lines["band"].iloc[0], *shift)], columns=["raster_id", "band", "dy", "dx"])

    return work


def with_reference(raster: DataFrame, order: list[str] = K.REFERENCE_BAND_ORDER) -> DataFrame:
    """Pair each pixel of every other band with the pixel of its capture's reference band."""
    rank = F.array_position(F.array(*[F.lit(b) for b in order]), F.col("band"))
    chosen = raster.where(rank > 0).groupBy("raster_id").agg(F.min_by("band", rank).alias("ref_band"))
    tagged = raster.join(chosen, "raster_id")
    ref = tagged.where("band = ref_band").select("raster_id", "row", "col", F.col("value").alias("ref"))
    return tagged.where("band <> ref_band").join(ref, ["raster_id", "row", "col"]).select(
        *LINE, "row", "col", "value", "ref")


def band_register(raster: DataFrame, max_shift: int = 40, method: str = "phase", min_overlap: float = 0.5,
                  order: list[str] = K.REFERENCE_BAND_ORDER) -> DataFrame:
    """Whole-pixel shift (dy, dx) that lays each band on its capture's reference band.

    The reference is the first band of ``order`` that a capture has; a capture with none of them gives nothing.  Where
    one band is the reference of the whole dataset, ``order`` is that band alone.

    phase: one band of a capture at a time goes through a Fourier transform (a group is one image of the sensor).
    search: every shift is scored by correlation in plain columns; at least ``min_overlap`` of the pixels must meet.
    Nodata and values that are not finite take no part.
    """
    both = with_reference(clean(raster), order)
    if method == "phase":
        # pixels travel to Python as one row per image line, not with their keys on every pixel
        px = F.collect_list(F.struct("col", F.coalesce("value", F.lit(float("nan"))).alias("value"),
                                     F.coalesce("ref", F.lit(float("nan"))).alias("ref")))
        lines = both.groupBy(*LINE, "row").agg(px.alias("px")).select(
            *LINE, "row", F.col("px.col").alias("cols"), F.col("px.value").alias("values"), F.col("px.ref").alias("refs"))
        return lines.groupBy(*LINE).applyInPandas(_phase(max_shift), "raster_id string, band string, dy int, dx int")
    span = F.sequence(F.lit(-max_shift), F.lit(max_shift))
    size = both.groupBy(*LINE).agg(F.count("*").alias("_size"))
    mov = both.select(*LINE, "row", "col", "value").where("value IS NOT NULL")
    mov = mov.withColumn("dy", F.explode(span)).withColumn("dx", F.explode(span))
    mov = mov.withColumns({"row": F.col("row") + F.col("dy"), "col": F.col("col") + F.col("dx")})
    scored = (mov.join(both.where("ref IS NOT NULL").select(*LINE, "row", "col", "ref"), [*LINE, "row", "col"])
              .groupBy(*LINE, "dy", "dx").agg(F.count("*").alias("_n"), F.corr("value", "ref").alias("_c")))
    usable = scored.join(size, LINE).where((F.col("_n") >= F.col("_size") * min_overlap) & F.col("_c").isNotNull()
                                           & ~F.isnan("_c"))
    best = F.max_by(F.struct("dy", "dx"), F.struct(F.round("_c", 9).alias("c"), (-F.abs("dy") - F.abs("dx")).alias("s"), "dy", "dx"))
    return usable.groupBy(*LINE).agg(best.alias("b")).select(*LINE, "b.dy", "b.dx")


def apply_shift(raster: DataFrame, shifts: DataFrame) -> DataFrame:
    """Move each band by its shift; the edge it leaves becomes nodata."""
    size = raster.groupBy(*LINE).agg((F.max("row") + 1).alias("_h"), (F.max("col") + 1).alias("_w"))
    df = raster.join(shifts.select(*LINE, "dy", "dx"), LINE, "left").fillna(0, ["dy", "dx"]).join(size, LINE)
    r, c = F.col("row") + F.col("dy"), F.col("col") + F.col("dx")
    stays = (r >= 0) & (r < F.col("_h")) & (c >= 0) & (c < F.col("_w"))
    return df.select(*LINE, F.pmod(r, F.col("_h")).cast("int").alias("row"), F.pmod(c, F.col("_w")).cast("int").alias("col"),
                     F.when(stays, F.col("value")).alias("value"))


def numbered(images: DataFrame, flight: str, order: list[str]) -> DataFrame:
    """0-based position of each image in its flight, by time; busy flights are split by hour."""
    hour = F.unix_seconds(F.date_trunc("hour", order[0]).cast("timestamp"))
    out = bucketed_row_number(images, [flight], order, hour)
    return out.withColumn("ordinal", F.col("ordinal") - 1)
