"""WGS84 conversions, rotations and similarity transforms as columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathline.functions import constants as K

A, E2 = K.WGS84_A, K.WGS84_E2
FLAT = 1 - math.sqrt(1 - E2)
B = A * (1 - FLAT)
ECC = math.sqrt(E2)
_n = FLAT / (2 - FLAT)
# transverse Mercator series in the third flattening, to the fourth power
RADIUS = A / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64)
FORWARD = [_n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16 + 41 * _n**4 / 180,
           13 * _n**2 / 48 - 3 * _n**3 / 5 + 557 * _n**4 / 1440,
           61 * _n**3 / 240 - 103 * _n**4 / 140, 49561 * _n**4 / 161280]
BACK = [_n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96 - _n**4 / 360,
        _n**2 / 48 + _n**3 / 15 - 437 * _n**4 / 1440,
        17 * _n**3 / 480 - 37 * _n**4 / 840, 4397 * _n**4 / 161280]
LATITUDE = [2 * _n - 2 * _n**2 / 3 - 2 * _n**3 + 116 * _n**4 / 45,
            7 * _n**2 / 3 - 8 * _n**3 / 5 - 227 * _n**4 / 45,
            56 * _n**3 / 15 - 136 * _n**4 / 35, 4279 * _n**4 / 630]
SCALE0, EAST0, SOUTH0 = 0.9996, 500000.0, 10000000.0


def gps_to_ecef(df: DataFrame) -> DataFrame:
    """lat, lon (degrees), alt (metres) -> ex, ey, ez."""
    lat, lon = F.radians("lat"), F.radians("lon")
    df = df.withColumn("_big", A / F.sqrt(1 - E2 * F.sin(lat) * F.sin(lat)))
    flat = (F.col("_big") + F.col("alt")) * F.cos(lat)
    return df.withColumns({"ex": flat * F.cos(lon), "ey": flat * F.sin(lon),
                           "ez": ((1 - E2) * F.col("_big") + F.col("alt")) * F.sin(lat)}).drop("_big")


def ecef_to_gps(df: DataFrame) -> DataFrame:
    """ex, ey, ez -> lat, lon, alt; two rounds of the auxiliary-latitude formula (far below 1 mm)."""
    x, y, z = F.col("ex"), F.col("ey"), F.col("ez")
    df = df.withColumn("_p", F.sqrt(x * x + y * y))
    df = df.withColumn("_th", F.atan2(z * A, F.col("_p") * B))
    second = E2 / (1 - E2)
    for _ in range(2):
        s, c = F.sin("_th"), F.cos("_th")
        df = df.withColumn("_phi", F.atan2(z + second * B * s * s * s, F.col("_p") - E2 * A * c * c * c))
        df = df.withColumn("_th", F.atan2((1 - FLAT) * F.sin("_phi"), F.cos("_phi")))
    s = F.sin("_phi")
    height = F.col("_p") * F.cos("_phi") + z * s - A * F.sqrt(1 - E2 * s * s)
    return df.withColumns({"lat": F.degrees("_phi"), "lon": F.degrees(F.atan2(y, x)), "alt": height}).drop(
        "_p", "_th", "_phi")


def utm_epsg(df: DataFrame) -> DataFrame:
    zone = F.floor((F.col("lon") + 180.0) / 6.0) + 1
    return df.withColumn("epsg", (F.when(F.col("lat") >= 0, 32600).otherwise(32700) + zone).cast("int"))


def _zone(epsg: int | Column) -> tuple[Column, Column]:
    code = epsg if isinstance(epsg, Column) else F.lit(epsg)
    meridian = (code % 100 - 1) * 6 - 177.0
    return meridian, F.when(F.floor(code / 100) == 327, SOUTH0).otherwise(0.0)


def gps_to_utm(df: DataFrame, epsg: int | Column) -> DataFrame:
    """lat, lon -> east, north (metres)."""
    meridian, base = _zone(epsg)
    df = df.withColumns({"_s": F.sin(F.radians("lat")), "_dl": F.radians(F.col("lon") - meridian)})
    df = df.withColumn("_t", F.sinh(F.atanh("_s") - ECC * F.atanh(ECC * F.col("_s"))))
    df = df.withColumns({"_xi": F.atan2(F.col("_t"), F.cos("_dl")),
                         "_eta": F.atanh(F.sin("_dl") / F.sqrt(1 + F.col("_t") * F.col("_t")))})
    east, north = F.col("_eta"), F.col("_xi")
    for j, a in enumerate(FORWARD, 1):
        east = east + a * F.cos(2 * j * F.col("_xi")) * F.sinh(2 * j * F.col("_eta"))
        north = north + a * F.sin(2 * j * F.col("_xi")) * F.cosh(2 * j * F.col("_eta"))
    return df.withColumns({"east": EAST0 + SCALE0 * RADIUS * east,
                           "north": base + SCALE0 * RADIUS * north}).drop("_s", "_dl", "_t", "_xi", "_eta")


def utm_to_gps(df: DataFrame, epsg: int | Column) -> DataFrame:
    """east, north -> lat, lon (degrees)."""
    meridian, base = _zone(epsg)
    df = df.withColumns({"_x": (F.col("north") - base) / (SCALE0 * RADIUS),
                         "_y": (F.col("east") - EAST0) / (SCALE0 * RADIUS)})
    xi, eta = F.col("_x"), F.col("_y")
    for j, b in enumerate(BACK, 1):
        xi = xi - b * F.sin(2 * j * F.col("_x")) * F.cosh(2 * j * F.col("_y"))
        eta = eta - b * F.cos(2 * j * F.col("_x")) * F.sinh(2 * j * F.col("_y"))
    df = df.withColumns({"_xi": xi, "_eta": eta})
    df = df.withColumn("_chi", F.asin(F.sin("_xi") / F.cosh("_eta")))
    lat = F.col("_chi")
    for j, d in enumerate(LATITUDE, 1):
        lat = lat + d * F.sin(2 * j * F.col("_chi"))
    return df.withColumns({"lat": F.degrees(lat),
                           "lon": meridian + F.degrees(F.atan2(F.sinh("_eta"), F.cos("_xi")))}).drop(
        "_x", "_y", "_xi", "_eta", "_chi")


def ecef_to_utm(df: DataFrame, epsg: int | Column) -> DataFrame:
    """ex, ey, ez -> east, north, height."""
    kept = [c for c in df.columns if c not in ("lat", "lon", "alt")]
    out = gps_to_utm(ecef_to_gps(df), epsg)
    return out.select(*kept, "east", "north", F.col("alt").alias("height"))


def utm_to_ecef(df: DataFrame, epsg: int | Column) -> DataFrame:
    """east, north, height -> ex, ey, ez."""
    kept = [c for c in df.columns if c not in ("lat", "lon", "alt")]
    out = gps_to_ecef(utm_to_gps(df, epsg).withColumn("alt", F.col("height")))
    return out.select(*kept, "ex", "ey", "ez")


def point_reproject(points: DataFrame, epsg: int) -> DataFrame:
    """Points x, y, z in ECEF -> the same points in UTM."""
    moved = ecef_to_utm(points.withColumnsRenamed({"x": "ex", "y": "ey", "z": "ez"}), epsg)
    return moved.withColumns({"x": F.col("east"), "y": F.col("north"), "z": F.col("height")}).drop(
        "ex", "ey", "ez", "east", "north", "height")


def gps_centroid(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    means = df.groupBy(*(keys or [])).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    return utm_epsg(means)


def quat_to_rot(df: DataFrame) -> DataFrame:
    """Unit quaternion qw, qx, qy, qz -> rotation matrix r00 .. r22."""
    w, x, y, z = (F.col(c) for c in ("qw", "qx", "qy", "qz"))
    rows = [[1 - 2 * y * y - 2 * z * z, 2 * x * y - 2 * w * z, 2 * x * z + 2 * w * y],
            [2 * x * y + 2 * w * z, 1 - 2 * x * x - 2 * z * z, 2 * y * z - 2 * w * x],
            [2 * x * z - 2 * w * y, 2 * y * z + 2 * w * x, 1 - 2 * x * x - 2 * y * y]]
    return df.withColumns({f"r{i}{j}": rows[i][j] for i in range(3) for j in range(3)})


def camera_centre(df: DataFrame) -> DataFrame:
    """Position of the camera, -R^T t, as cx, cy, cz."""
    rot = quat_to_rot(df)
    t = [F.col(c) for c in ("tx", "ty", "tz")]
    centre = {f"c{a}": -sum((F.col(f"r{i}{j}") * t[i] for i in range(1, 3)), F.col(f"r0{j}") * t[0])
              for j, a in enumerate("xyz")}
    return rot.withColumns(centre)


@dataclass(frozen=True)
class Sim3:
    """Similarity transform P = scale * R x + t, kept on the driver as eight numbers."""

    scale: float
    q: tuple[float, float, float, float]
    t: tuple[float, float, float]

    @property
    def rotation(self) -> list[list[float]]:
        w, x, y, z = self.q
        return [[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
                [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
                [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]]


def sim3_apply(df: DataFrame, sim: Sim3, source=("x", "y", "z"), target=("ex", "ey", "ez")) -> DataFrame:
    r, p = sim.rotation, [F.col(c) for c in source]
    return df.withColumns({target[i]: sim.scale * (r[i][0] * p[0] + r[i][1] * p[1] + r[i][2] * p[2]) + sim.t[i]
                           for i in range(3)})


def sim3_invert(df: DataFrame, sim: Sim3, source=("ex", "ey", "ez"), target=("x", "y", "z")) -> DataFrame:
    r, d = sim.rotation, [F.col(c) - sim.t[i] for i, c in enumerate(source)]
    return df.withColumns({target[i]: (r[0][i] * d[0] + r[1][i] * d[1] + r[2][i] * d[2]) / sim.scale
                           for i in range(3)})


def _rot_to_quat(r: np.ndarray) -> tuple[float, float, float, float]:
    """Largest-component form, stable for every rotation."""
    m = np.array([
        [r[0, 0] + r[1, 1] + r[2, 2], 0, 0, 0],
        [r[2, 1] - r[1, 2], r[0, 0] - r[1, 1] - r[2, 2], 0, 0],
        [r[0, 2] - r[2, 0], r[1, 0] + r[0, 1], r[1, 1] - r[0, 0] - r[2, 2], 0],
        [r[1, 0] - r[0, 1], r[2, 0] + r[0, 2], r[2, 1] + r[1, 2], r[2, 2] - r[0, 0] - r[1, 1]]])
    values, vectors = np.linalg.eigh((m + np.tril(m, -1).T) / 3.0)
    q = vectors[:, np.argmax(values)]
    q = q if q[0] >= 0 else -q
    return tuple(float(v) for v in q)


def sim3_fit(local: DataFrame, ecef: DataFrame, max_error: float = 3.0, rounds: int = 20) -> tuple[Sim3, dict]:
    """Least-squares similarity from local (name, x, y, z) to ECEF (name, ex, ey, ez).

    Each round is one aggregate of moments over the matched cameras; only those 17 numbers reach the
    driver, where the 3x3 problem is solved.  ``converged`` in the report is false when ``rounds`` ended first.  Cameras farther than the bound are left out of the next
    round; the bound falls to ``max_error``.
    """
    pairs = local.select("name", "x", "y", "z").join(ecef.select("name", "ex", "ey", "ez"), "name").persist()
    src, dst = ["x", "y", "z"], ["ex", "ey", "ez"]
    sim, bound, last, converged = None, None, None, False
    try:
        for _ in range(rounds):
            kept = pairs
            if sim is not None:
                kept = _with_error(pairs, sim).where(F.col("_err") <= bound)
            row = kept.agg(
                F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in src + dst],
                sum((F.var_pop(c) for c in src[1:]), F.var_pop("x")).alias("var"),
                *[F.covar_pop(d, s).alias(f"{d}_{s}") for d in dst for s in src]).first()
            if row["n"] < 3:
                raise ValueError("fewer than three cameras agree with the reference")
            cov = np.array([[row[f"{d}_{s}"] for s in src] for d in dst])
            u, sing, vt = np.linalg.svd(cov)
            sign = np.diag([1.0, 1.0, np.sign(np.linalg.det(u) * np.linalg.det(vt))])
            rot = u @ sign @ vt
            scale = float(np.trace(np.diag(sing) @ sign) / row["var"])
            t = np.array([row[f"m_{d}"] for d in dst]) - scale * rot @ np.array([row[f"m_{s}"] for s in src])
            sim = Sim3(scale, _rot_to_quat(rot), tuple(float(v) for v in t))
            err = _with_error(pairs, sim)
            if bound is not None:
                err = err.where(F.col("_err") <= bound)
            rmse = err.agg(F.sqrt(F.avg(F.col("_err") * F.col("_err"))).alias("r")).first()["r"]
            state = (row["n"], bound)
            if bound == max_error and last == state:
                converged = True
                break
            last = state
            bound = max(max_error, rmse) if bound is None or bound > max_error else max_error
        total = _with_error(pairs, sim).agg(
            F.count("*").alias("n"), F.count_if(F.col("_err") <= max_error).alias("inliers"),
            F.sqrt(F.avg(F.when(F.col("_err") <= max_error, F.col("_err") * F.col("_err")))).alias("rmse")).first()
    finally:
        pairs.unpersist()
    report = {"converged": converged, "cameras": total["n"], "inliers": total["inliers"], "rmse": total["rmse"],
              "scale_warning": abs(sim.scale - 1.0) > 0.10, "rmse_warning": total["rmse"] > 5.0 * max_error}
    return sim, report


def _with_error(pairs: DataFrame, sim: Sim3) -> DataFrame:
    moved = sim3_apply(pairs, sim, target=("_px", "_py", "_pz"))
    d = [F.col(f"_p{a}") - F.col(f"e{a}") for a in "xyz"]
    return moved.withColumn("_err", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])).drop("_px", "_py", "_pz")


def outlier_cameras(poses: DataFrame, gps: DataFrame, max_error: float = 10.0) -> DataFrame:
    """Flag cameras (name, cx, cy, cz in ECEF) farther than ``max_error`` from their GPS position.

    Cameras without a reference are kept.
    """
    ref = gps_to_ecef(gps.select("name", "lat", "lon", "alt")).select("name", "ex", "ey", "ez")
    d = [F.col(f"c{a}") - F.col(f"e{a}") for a in "xyz"]
    out = poses.join(ref, "name", "left").withColumn(
        "error", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]))
    return out.withColumn("removed", F.coalesce(F.col("error") > max_error, F.lit(False))).drop("ex", "ey", "ez")
