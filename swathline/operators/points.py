"""Point clouds: gridding, colour rasters, voxels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathline.operators.grid import Grid


def _idw(z: Column, d: Column) -> Column:
    """Inverse-distance mean; points exactly on the centre decide alone."""
    hit = d == 0
    return F.coalesce(F.avg(F.when(hit, z)),
                      F.sum(F.when(~hit, z / d)) / F.sum(F.when(~hit, 1.0 / d)))


# choice of cell statistic: name -> aggregate of (height, distance to the cell centre)
GRID_STATS: dict[str, Callable[[Column, Column], Column]] = {
    "max": lambda z, d: F.max(z),
    "min": lambda z, d: F.min(z),
    "mean": lambda z, d: F.avg(z),
    "idw": _idw,
    "count": lambda z, d: F.count(z).cast("double"),
}


def points_in_radius(points: DataFrame, grid: Grid, radius: float) -> DataFrame:
    """Each point once per cell whose centre lies within ``radius``; adds row, col, dist.

    When a point touches many cells the points are range-partitioned by place first, so that one task
    expands neighbouring points and its partial aggregate meets the same cells again.  The range key
    ends in the coordinates, so a crowded tile is split over several tasks.
    """
    ax, ay = abs(grid.dx), abs(grid.dy)
    if (radius / ax) * (radius / ay) > 9:
        side = 64
        points = points.repartitionByRange(
            F.floor(F.col("y") / (ay * side)), F.floor(F.col("x") / (ax * side)), "y", "x")

    def span(value: Column, half: Column, origin: float, step: float, last: int) -> Column:
        """Cells along one axis whose centres lie within ``half`` of the value (a hair more for rounding)."""
        a, b = (value - half - origin) / step - 0.5, (value + half - origin) / step - 0.5
        lo = F.greatest(F.ceil(F.least(a, b) - 1e-9), F.lit(0)).cast("int")
        hi = F.least(F.floor(F.greatest(a, b) + 1e-9), F.lit(last)).cast("int")
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    reach = F.lit(float(radius))
    rows = points.withColumn("row", F.explode(span(F.col("y"), reach, grid.y0, grid.dy, grid.height - 1)))
    ey = F.col("y") - grid.centre_y(F.col("row"))
    half = F.sqrt(F.greatest(reach * reach - ey * ey, F.lit(0.0)))
    cells = rows.withColumn("col", F.explode(span(F.col("x"), half, grid.x0, grid.dx, grid.width - 1)))
    ex = F.col("x") - grid.centre_x(F.col("col"))
    d2 = ex * ex + ey * ey
    return cells.withColumn("dist2", d2).where(F.col("dist2") <= radius * radius).withColumn(
        "dist", F.sqrt("dist2")).drop("dist2")


def grid_points(points: DataFrame, grid: Grid, stat: str = "max", radius: float = 0.5,
                band: str = "dsm") -> DataFrame:
    """Grid heights (x, y, z) into a raster of the cells that any point reaches."""
    value = GRID_STATS[stat](F.col("z"), F.col("dist"))
    return (points_in_radius(points, grid, radius).groupBy("row", "col").agg(value.alias("value"))
            .select(F.lit(grid.raster_id).alias("raster_id"), F.lit(band).alias("band"), "row", "col", "value"))


def rgb_ortho(points: DataFrame, grid: Grid, radius: float = 0.5, window: int = 3) -> DataFrame:
    """Mean colour per cell, all three channels in one pass; gaps take nearby cells by inverse distance.

    Only empty cells look around, at most ``window`` cells each way.  Returns row, col, red, green, blue.
    """
    channels = ["red", "green", "blue"]
    seen = points_in_radius(points, grid, radius).groupBy("row", "col").agg(
        *[F.avg(c).alias(c) for c in channels])
    reach = F.sequence(F.lit(-window), F.lit(window))
    gaps = grid.cells(points.sparkSession).join(seen, ["row", "col"], "left_anti")
    near = (gaps.select(F.col("row").alias("r0"), F.col("col").alias("c0"), F.explode(reach).alias("dr"))
            .select("r0", "c0", "dr", F.explode(reach).alias("dc"))
            .withColumns({"row": F.col("r0") + F.col("dr"), "col": F.col("c0") + F.col("dc")}))
    w = 1.0 / F.sqrt((F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")).cast("double"))
    filled = (near.join(seen, ["row", "col"]).withColumn("w", w)
              .groupBy(F.col("r0").alias("row"), F.col("c0").alias("col"))
              .agg(*[(F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(c) for c in channels]))
    out = seen.unionByName(filled)
    return out.select("row", "col", *[
        F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.round(F.col(c), 6)))).cast("int").alias(c)
        for c in channels])


def voxel_downsample(points: DataFrame, size: float = 0.01) -> DataFrame:
    """Average the points of each cube of side ``size``."""
    cube = [F.floor(F.col(c) / size).alias(f"v{c}") for c in "xyz"]
    carried = [c for c in ("x", "y", "z", "red", "green", "blue") if c in points.columns]
    return (points.groupBy(*cube).agg(*[F.avg(c).alias(c) for c in carried], F.count("*").alias("n")))
