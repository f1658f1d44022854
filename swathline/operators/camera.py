"""Projecting ground cells into posed images and sampling them."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swathline.functions import constants as K
from swathline.functions.scalars import settle
from swathline.operators.geodesy import Sim3, quat_to_rot, sim3_invert, utm_to_ecef
from swathline.operators.grid import LINE, Grid, clean
from swathline.session import cut

POSE = [f"r{i}{j}" for i in range(3) for j in range(3)] + ["tx", "ty", "tz"]


@dataclass(frozen=True)
class Camera:
    """Pinhole camera; ``dist`` is k1, k2, p1, p2, k3, k4, k5, k6."""

    width: int
    height: int
    fx: float
    fy: float
    cx: float
    cy: float
    dist: Sequence[float] = field(default=(0.0,) * 8)

    def radial(self, r2, model: str):
        k1, k2, _, _, k3, k4, k5, k6 = self.dist
        if model == "rational":
            return (1 + r2 * (k1 + r2 * (k2 + r2 * k3))) / (1 + r2 * (k4 + r2 * (k5 + r2 * k6)))
        return 1 + r2 * (k1 + r2 * (k2 + r2 * (k3 + r2 * (k4 + r2 * (k5 + r2 * k6)))))

    def half_angle(self, model: str) -> float:
        """Angle from the axis beyond which no point can land in the frame (half turn when there is none)."""
        reach = math.hypot(max(self.cx, self.width - self.cx) / self.fx,
                           max(self.cy, self.height - self.cy) / self.fy)
        rho = np.concatenate([np.linspace(0, 4, 4001), np.geomspace(4, 1e4, 4000)])
        with np.errstate(all="ignore"):
            bent = np.abs(rho * self.radial(rho * rho, model)) - 3 * rho * rho * (abs(self.dist[2]) + abs(self.dist[3]))
        inside = np.nonzero(bent <= reach * 1.01)[0]
        last = inside[-1]
        return math.pi / 2 if last + 1 >= len(rho) else math.atan(rho[last + 1])


def cells_to_local(cells: DataFrame, grid: Grid, sim: Sim3) -> DataFrame:
    """Cell centres (row, col, z) of a UTM grid -> x, y, z of the reconstruction's own frame."""
    df = cells.withColumns({"east": grid.centre_x(F.col("col")), "north": grid.centre_y(F.col("row")),
                            "height": F.col("z")}).drop("z")
    return sim3_invert(utm_to_ecef(df, grid.epsg), sim).drop("east", "north", "height", "ex", "ey", "ez")


def project_pinhole(pairs: DataFrame, camera: Camera, model: str = "polynomial") -> DataFrame:
    """Rows with a point (x, y, z) and a pose (r00 .. r22, tx, ty, tz) -> u, v, in_front."""
    p = [F.col(c) for c in "xyz"]
    df = pairs.withColumns({f"_c{i}": F.col(f"r{i}0") * p[0] + F.col(f"r{i}1") * p[1] + F.col(f"r{i}2") * p[2]
                            + F.col("t" + "xyz"[i]) for i in range(3)})
    df = df.withColumn("in_front", F.col("_c2") > 1e-6)
    depth = F.when(F.col("in_front"), F.col("_c2")).otherwise(1.0)
    df = df.withColumns({"_x": F.col("_c0") / depth, "_y": F.col("_c1") / depth})
    df = df.withColumn("_r2", F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y"))
    df = df.withColumn("_k", F.lit(0.0) + camera.radial(F.col("_r2"), model))
    p1, p2 = camera.dist[2], camera.dist[3]
    x, y, r2 = F.col("_x"), F.col("_y"), F.col("_r2")
    xd = x * F.col("_k") + 2 * p1 * x * y + p2 * (r2 + 2 * x * x)
    yd = y * F.col("_k") + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y
    df = df.withColumns({"u": camera.fx * xd + camera.cx, "v": camera.fy * yd + camera.cy}).drop(
        "_c0", "_c1", "_c2", "_x", "_y", "_r2", "_k")
    return settle(df, "in_front", "u", "v")


def in_frame(camera: Camera) -> Column:
    return (F.col("in_front") & (F.col("u") >= 0) & (F.col("u") < camera.width)
            & (F.col("v") >= 0) & (F.col("v") < camera.height))


def project_join(cells: DataFrame, poses: DataFrame, camera: Camera, model: str = "polynomial",
                 tile: int = 64) -> DataFrame:
    """Every (cell, image) where the cell falls inside the image, with its pixel u, v.

    ``cells``: row, col, x, y, z in the local frame.  ``poses``: image_id, qw .. qz, tx, ty, tz.
    Candidates come from a descent through square blocks of cells: an image keeps a block only when its
    view cone can touch the block's bounding ball, and only kept blocks are split further.  No image is
    paired with cells it cannot see, and no visible cell is lost.
    """
    rot = quat_to_rot(poses).select("image_id", *POSE)
    tiled = cells.withColumns({"tr": F.floor(F.col("row") / tile), "tc": F.floor(F.col("col") / tile)})
    # the cells are read once for the blocks' boxes and once for the pairs; all levels come from this small table
    blocks = cut(tiled.groupBy("tr", "tc").agg(
        *[f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]))
    top = blocks.agg(F.max(F.greatest("tr", "tc")).alias("m")).first()["m"]  # one number: the depth of the tree
    depth = 0 if not top else math.ceil(math.log2(top + 1))
    half = camera.half_angle(model)

    def at(level: int) -> DataFrame:
        side = 2 ** level
        return blocks.groupBy(F.floor(F.col("tr") / side).alias("br"), F.floor(F.col("tc") / side).alias("bc")).agg(
            *[f(f"{n}{c}").alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])

    def seen(df: DataFrame) -> DataFrame:
        mid = [(F.col(f"lo{c}") + F.col(f"hi{c}")) / 2 for c in "xyz"]
        ext = [(F.col(f"hi{c}") - F.col(f"lo{c}")) / 2 for c in "xyz"]
        df = df.withColumn("_rad", F.sqrt(ext[0] * ext[0] + ext[1] * ext[1] + ext[2] * ext[2]) + 1e-9)
        df = df.withColumns({f"_c{i}": F.col(f"r{i}0") * mid[0] + F.col(f"r{i}1") * mid[1] + F.col(f"r{i}2") * mid[2]
                             + F.col("t" + "xyz"[i]) for i in range(3)})
        dist = F.sqrt(F.col("_c0") * F.col("_c0") + F.col("_c1") * F.col("_c1") + F.col("_c2") * F.col("_c2"))
        df = settle(df.withColumn("_d", dist), "_c2", "_d", "_rad")
        cone = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_c2") / F.col("_d"))))
        near = F.col("_d") <= F.col("_rad")
        hit = near | (cone <= half + F.asin(F.least(F.lit(1.0), F.col("_rad") / F.col("_d"))) + 1e-6)
        return df.where(hit).select("image_id", *POSE, "br", "bc")

    # the root is one block, or none without cells
    live = seen(rot.crossJoin(F.broadcast(at(depth))))
    two = F.array(F.lit(0), F.lit(1))
    for level in range(depth - 1, -1, -1):
        live = (live.withColumn("_i", F.explode(two)).withColumn("_j", F.explode(two))
                .withColumns({"br": F.col("br") * 2 + F.col("_i"), "bc": F.col("bc") * 2 + F.col("_j")}).drop("_i", "_j"))
        live = seen(live.join(at(level), ["br", "bc"]))
    pairs = live.join(tiled.withColumnsRenamed({"tr": "br", "tc": "bc"}), ["br", "bc"]).drop("br", "bc")
    return project_pinhole(pairs, camera, model).where(in_frame(camera)).drop(*POSE, "in_front")


def invert3(df: DataFrame, source: str, prefix: str) -> DataFrame:
    """Inverse of a 3x3 matrix held as an array of nine, as columns prefix0 .. prefix8 (NULL if singular)."""
    h = [F.col(source)[i] for i in range(9)]

    def minor(a: int, b: int, c: int, d: int) -> Column:
        return h[a] * h[d] - h[b] * h[c]

    adj = [minor(4, 5, 7, 8), -minor(1, 2, 7, 8), minor(1, 2, 4, 5),
           -minor(3, 5, 6, 8), minor(0, 2, 6, 8), -minor(0, 2, 3, 5),
           minor(3, 4, 6, 7), -minor(0, 1, 6, 7), minor(0, 1, 3, 4)]
    det = h[0] * adj[0] + h[1] * adj[3] + h[2] * adj[6]
    return df.withColumn("_det", F.nullif(det, F.lit(0.0))).withColumns(
        {f"{prefix}{i}": a / F.col("_det") for i, a in enumerate(adj)}).drop("_det")


def band_pixel(proj: DataFrame, geometry: DataFrame) -> DataFrame:
    """Frame pixel (image_id, u, v) -> pixel of each band (band, ub, vb).

    ``geometry``: image_id, band, raster_id, h (array of nine: band pixel -> frame pixel), off_x, off_y.
    """
    inv = invert3(geometry, "h", "_h").where("_h0 IS NOT NULL").drop("h")
    df = proj.join(inv, "image_id")
    u, v = F.col("u"), F.col("v")
    df = df.withColumn("_w", F.nullif(F.col("_h6") * u + F.col("_h7") * v + F.col("_h8"), F.lit(0.0)))
    return df.withColumns({
        "ub": (F.col("_h0") * u + F.col("_h1") * v + F.col("_h2")) / F.col("_w") - F.coalesce("off_x", F.lit(0.0)),
        "vb": (F.col("_h3") * u + F.col("_h4") * v + F.col("_h5")) / F.col("_w") - F.coalesce("off_y", F.lit(0.0)),
    }).drop("_w", "off_x", "off_y", *[f"_h{i}" for i in range(9)])


def _quads(raster: DataFrame) -> DataFrame:
    """Each pixel with its right, lower and lower-right neighbours (NULL where there is none)."""
    across, down = W.partitionBy(*LINE, "row").orderBy("col"), W.partitionBy(*LINE, "col").orderBy("row")
    quad = raster.select(*LINE, "row", "col", "value").withColumn(
        "_r", F.when(F.lead("col").over(across) == F.col("col") + 1, F.lead("value").over(across)))
    quad = quad.withColumn("_b", F.struct("value", "_r"))
    quad = quad.withColumn("_n", F.when(F.lead("row").over(down) == F.col("row") + 1, F.lead("_b").over(down)))
    return quad.select(*LINE, F.col("row").alias("_y"), F.col("col").alias("_x"), F.col("value").alias("_q00"),
                       F.col("_r").alias("_q01"), F.col("_n.value").alias("_q10"), F.col("_n._r").alias("_q11"))


def _whole(c: str) -> Column:
    """Lower whole number; far-off positions are held at a distance no image reaches."""
    return F.floor(F.greatest(F.lit(-1e8), F.least(F.lit(1e8), F.col(c)))).cast("int")


def bilinear_gather(raster: DataFrame, samples: DataFrame, nodata: float | None = None) -> DataFrame:
    """Add ``value`` sampled at fractional (ub, vb) = (column, row) of raster_id, band.

    All four pixels must exist, so the last row and column give nothing.  Each pixel first takes its right
    and lower neighbours along; a sample then needs one lookup.  A sample that touches nodata gives nothing; with ``nodata``, that number
    stands in for missing values instead.
    """
    src = clean(raster)
    src = src if nodata is None else src.withColumn("value", F.coalesce("value", F.lit(nodata)))
    at = samples.withColumns({"_x": _whole("ub"), "_y": _whole("vb")})
    hit = at.join(_quads(src), [*LINE, "_y", "_x"])
    fx, fy = F.col("ub") - F.col("_x"), F.col("vb") - F.col("_y")
    value = (F.col("_q00") * (1 - fx) * (1 - fy) + F.col("_q01") * fx * (1 - fy)
             + F.col("_q10") * (1 - fx) * fy + F.col("_q11") * fx * fy)
    return hit.withColumn("value", value).where(F.col("value").isNotNull()).select(*samples.columns, "value")


def bilinear_zero(raster: DataFrame, targets: DataFrame) -> DataFrame:
    """Raster resampled to ``targets`` (raster_id, band, row, col, ub, vb, moved); pixels outside count as 0.

    Nodata counts as 0 too.  One lookup per target.  Just outside the first column or row only the right or lower pixel counts: the
    lookup then goes to that pixel, which takes the weight.  Targets not ``moved`` keep their pixel as it is.
    """
    at = targets.withColumns({"_x0": _whole("ub"), "_y0": _whole("vb")})
    fx, fy = F.col("ub") - F.col("_x0"), F.col("vb") - F.col("_y0")
    left, top = F.col("_x0") == -1, F.col("_y0") == -1
    at = at.withColumns({
        "_x": F.when(left, 0).otherwise(F.col("_x0")), "_y": F.when(top, 0).otherwise(F.col("_y0")),
        "_wl": F.when(left, fx).otherwise(1 - fx), "_wr": F.when(left, 0.0).otherwise(fx),
        "_wt": F.when(top, fy).otherwise(1 - fy), "_wb": F.when(top, 0.0).otherwise(fy)})
    got = at.join(_quads(clean(raster)), [*LINE, "_y", "_x"], "left")

    def part(q: str, a: str, b: str) -> Column:
        return F.coalesce(F.col(q), F.lit(0.0)) * F.col(a) * F.col(b)

    value = part("_q00", "_wl", "_wt") + part("_q01", "_wr", "_wt") + part("_q10", "_wl", "_wb") + part("_q11", "_wr", "_wb")
    return got.select(*LINE, "row", "col", F.when(F.col("moved"), value).otherwise(F.col("_q00")).alias("value"))


def pose_composite(cells: DataFrame, poses: DataFrame, camera: Camera, raster: DataFrame, geometry: DataFrame,
                   feather: float = K.FEATHER_FRACTION, model: str = "polynomial") -> DataFrame:
    """Band values per ground cell, blended over the images that see it.

    The weight falls towards the frame's edge and is shared by the bands; a sampled 0 is nodata.
    """
    seen = project_join(cells, poses, camera, model)
    du = F.least(F.col("u"), camera.width - 1.0 - F.col("u")) / (0.5 * camera.width)
    dv = F.least(F.col("v"), camera.height - 1.0 - F.col("v")) / (0.5 * camera.height)
    ramp = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.least(du, dv) / feather))
    weighted = seen.withColumn("weight", F.greatest(ramp, F.lit(1e-3))).select("row", "col", "image_id", "u", "v", "weight")
    sampled = bilinear_gather(raster, band_pixel(weighted, geometry), nodata=K.POSE_NODATA)
    return (sampled.where(F.col("value") != K.POSE_NODATA).groupBy("band", "row", "col")
            .agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("value")))


def trajectory_stats(poses: DataFrame) -> DataFrame:
    """Per scene: cameras, centre of the box, pooled extent, mean step and path length.

    ``poses``: scene, ordinal (consecutive numbers), x, y, z.  Steps come from joining each camera to the
    one before it by number.
    """
    ends = [f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]
    box = poses.groupBy("scene").agg(F.count("*").alias("cameras"), *ends)
    box = box.select("scene", "cameras", *[((F.col(f"lo{c}") + F.col(f"hi{c}")) / 2).alias(f"centre_{c}") for c in "xyz"],
                     (F.greatest("hix", "hiy", "hiz") - F.least("lox", "loy", "loz")).alias("extent"))
    nxt = poses.select("scene", (F.col("ordinal") + 1).alias("ordinal"), *[F.col(c).alias(f"p{c}") for c in "xyz"])
    d = [F.col(c) - F.col(f"p{c}") for c in "xyz"]
    steps = poses.join(nxt, ["scene", "ordinal"]).withColumn(
        "step", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]))
    path = steps.groupBy("scene").agg(F.avg("step").alias("mean_step"), F.sum("step").alias("path_length"))
    return box.join(path, "scene", "left")
