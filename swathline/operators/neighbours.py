"""Neighbourhood work on rasters: stencils, distances along lines, erosion, hole filling.

Windows run along one raster line (a row, a column or a diagonal), never over a whole raster, so a
task holds one line at a time.  What follows a cell is read with the line in falling order: a frame that
starts at the line's first row is kept up to date row by row, one that ends at its last row is computed
anew for every cell.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swathline.operators.grid import LINE, clean

SIDES = ["nw", "n", "ne", "w", "c", "e", "sw", "s", "se"]


def stencil(raster: DataFrame, border: str = "null", keep: tuple[str, ...] = ()) -> DataFrame:
    """Dense raster -> each cell with its 3x3 neighbourhood as columns nw .. se.

    Two passes: the row gives (w, c, e), then the column carries that triple up and down.  ``border``
    outside the grid: "null", or "mirror" (the cell one step inside, without repeating the edge).  Columns
    named in ``keep`` pass through.
    """
    raster = clean(raster)
    across = W.partitionBy(*LINE, "row").orderBy("col")
    down = W.partitionBy(*LINE, "col").orderBy("row")

    def beside(step: int, axis: str, value: Column, win) -> Column:
        f = F.lag if step < 0 else F.lead
        return F.when(f(axis).over(win) == F.col(axis) + step, f(value).over(win))

    df = raster.withColumns({"w": beside(-1, "col", F.col("value"), across),
                             "e": beside(1, "col", F.col("value"), across),
                             "_first": F.lag("col").over(across).isNull(),
                             "_last": F.lead("col").over(across).isNull()})
    if border == "mirror":
        df = df.withColumns({"w": F.when(F.col("_first"), F.col("e")).otherwise(F.col("w")),
                             "e": F.when(F.col("_last"), F.col("w")).otherwise(F.col("e"))})
    df = df.withColumn("_t", F.struct("w", F.col("value").alias("c"), "e")).drop("_first", "_last")
    df = df.withColumns({"_n": beside(-1, "row", F.col("_t"), down), "_s": beside(1, "row", F.col("_t"), down),
                         "_first": F.lag("row").over(down).isNull(), "_last": F.lead("row").over(down).isNull()})
    if border == "mirror":
        df = df.withColumns({"_n": F.when(F.col("_first"), F.col("_s")).otherwise(F.col("_n")),
                             "_s": F.when(F.col("_last"), F.col("_n")).otherwise(F.col("_s"))})
    return df.select(
        *LINE, "row", "col", "value", *keep,
        F.col("_n.w").alias("nw"), F.col("_n.c").alias("n"), F.col("_n.e").alias("ne"), "w",
        F.col("value").alias("c"), "e", F.col("_s.w").alias("sw"), F.col("_s.c").alias("s"),
        F.col("_s.e").alias("se"))


def _runs(df: DataFrame, keys: list[str], along: str, left: str, right: str, island: str) -> DataFrame:
    """Distance to the ends of the run of consecutive valid cells along one axis (end cell = 1)."""
    line = W.partitionBy(*keys).orderBy(along)
    df = df.withColumn(island, F.col(along) - F.row_number().over(line))
    run = W.partitionBy(*keys, island)
    pos = F.row_number().over(run.orderBy(along))
    size = F.count("*").over(run)
    df = df.withColumns({left: pos, "_size": size})
    return df.withColumn(right, F.col("_size") - F.col(left) + 1).drop("_size")


def valid_weights(raster: DataFrame) -> DataFrame:
    """Valid cells with their value and blend weight: the least distance to nodata or the border, left,
    right, up and down.  A gap in the row or column numbers is where nodata or the border starts."""
    valid = clean(raster).where(F.col("value").isNotNull()).select(*LINE, "row", "col", "value")
    df = _runs(valid, [*LINE, "row"], "col", "_l", "_r", "_ih").drop("_ih")
    df = _runs(df, [*LINE, "col"], "row", "_u", "_d", "_iv").drop("_iv")
    return df.select(*LINE, "row", "col", "value", F.least("_l", "_r", "_u", "_d").cast("double").alias("weight"))


def edge_weight(raster: DataFrame) -> DataFrame:
    """Blend weight of every cell; 0 on nodata."""
    holes = clean(raster).where(F.col("value").isNull()).select(*LINE, "row", "col", F.lit(0.0).alias("weight"))
    return valid_weights(raster).drop("value").unionByName(holes)


def erode(mask: DataFrame, n: int) -> DataFrame:
    """``n`` passes of 4-connected erosion of the cells in ``mask`` (raster_id, row, col).

    A cell stays when its city-block distance to the nearest cell outside the mask exceeds n: the
    vertical distance per cell, then a running minimum along each row run.
    """
    if n <= 0:
        return mask
    key = ["raster_id"]
    df = _runs(mask.select("raster_id", "row", "col"), [*key, "col"], "row", "_u", "_d", "_iv")
    df = df.withColumn("_g", F.least("_u", "_d")).drop("_u", "_d", "_iv")
    df = _runs(df, [*key, "row"], "col", "_l", "_r", "_ih")
    run = W.partitionBy(*key, "row", "_ih").rowsBetween(W.unboundedPreceding, 0)
    before = F.min(F.col("_g") - F.col("col")).over(run.orderBy("col")) + F.col("col")
    after = F.min(F.col("_g") + F.col("col")).over(run.orderBy(F.desc("col"))) - F.col("col")
    df = df.withColumn("_dist", F.least("_l", "_r", before, after))
    return df.where(F.col("_dist") > n).select("raster_id", "row", "col")


def coverage_mask(dsm: DataFrame, unfilled: DataFrame | None = None, passes: tuple[int, int] = (15, 12)) -> DataFrame:
    """Cells with an elevation, eroded; cut to the eroded unfilled coverage where that is known."""

    def valid(r: DataFrame) -> DataFrame:
        return clean(r).where(F.col("value").isNotNull()).select("raster_id", "row", "col")

    mask = erode(valid(dsm), passes[0])
    if unfilled is None:
        return mask
    return mask.join(erode(valid(unfilled), passes[1]), ["raster_id", "row", "col"], "left_semi")


def nearest_rows(rows: list[int], beside: list[int], wanted: np.ndarray) -> np.ndarray:
    """Places in ``rows`` (rising) of the cells nearest to each row in ``wanted``: the smallest squared row distance plus ``beside``,
    ties to the smaller row.  The lower envelope of one parabola a row, in whole numbers."""
    hull: list[int] = []
    starts: list[int] = []
    for j, (r, f) in enumerate(zip(rows, beside, strict=True)):
        start = -(1 << 62)
        while hull:
            i = hull[-1]
            # the first row at which j is nearer than i
            start = (f + r * r - beside[i] - rows[i] * rows[i]) // (2 * (r - rows[i])) + 1
            if start > starts[-1]:
                break
            hull.pop()
            starts.pop()
            start = -(1 << 62)
        hull.append(j)
        starts.append(start)
    return np.array(hull, np.int64)[np.searchsorted(np.array(starts, np.int64), wanted, "right") - 1]


def nearest_valid(raster: DataFrame, max_distance: int | None = None) -> DataFrame:
    """Dense raster -> holes take the value of the nearest valid cell, however far (or up to ``max_distance`` away).

    Ties go to the smaller row, then column.  An exact distance transform in two line passes: along each row every cell learns the
    closest valid cell of its row, then along each column the lower envelope of the parabolas that these distances open gives
    every hole its cell.  No row is multiplied, and a task holds one column of one raster at a time.  A raster without a valid cell
    keeps its holes; an empty raster gives no rows.
    """
    raster = clean(raster)
    across = W.partitionBy(*LINE, "row").rowsBetween(W.unboundedPreceding, 0)
    here = F.when(F.col("value").isNotNull(), F.struct("col", "value"))
    sides = raster.withColumns({
        "_l": F.last(here, ignorenulls=True).over(across.orderBy("col")),
        "_r": F.last(here, ignorenulls=True).over(across.orderBy(F.desc("col")))})
    left = F.col("_r").isNull() | (F.col("col") - F.col("_l.col") <= F.col("_r.col") - F.col("col"))
    near = F.when(left, F.col("_l")).otherwise(F.col("_r"))
    rows = sides.select(*LINE, "row", "col", F.col("value").cast("double").alias("value"), near.alias("_n")).select(
        *LINE, "row", "col", "value", F.coalesce(F.col("_n.col") - F.col("col"), F.lit(0)).cast("long").alias("_beside"), F.col("_n.value").cast("double").alias("_found"))

    def down(column: pd.DataFrame) -> pd.DataFrame:
        column = column.sort_values("row", ignore_index=True)
        hole, seen = column["value"].isna().to_numpy(), np.flatnonzero(column["_found"].notna())
        if hole.any() and len(seen):
            row, beside = column["row"].to_numpy(np.int64), column["_beside"].to_numpy(np.int64)
            at = seen[nearest_rows(row[seen].tolist(), (beside[seen] ** 2).tolist(), row[hole])]
            value = column["_found"].to_numpy(float)[at]
            if max_distance is not None:
                value = np.where((row[at] - row[hole]) ** 2 + beside[at] ** 2 <= max_distance * max_distance, value, np.nan)
            column.loc[hole, "value"] = value
        return column[[*LINE, "row", "col", "value"]].assign(was_hole=hole)

    kinds = {f.name: f.dataType.simpleString() for f in raster.schema}
    filled = rows.groupBy(*LINE, "col").applyInPandas(down, ", ".join(f"{c} {kinds[c]}" for c in (*LINE, "row", "col")) + ", value double, was_hole boolean")
    return filled.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


def fill_holes(raster: DataFrame, max_distance: int = 100, smooth: int = 0) -> DataFrame:
    """Dense raster -> holes take the inverse-distance mean of the nearest valid cells in 8 directions.

    The directions are along the row, the column and both diagonals, each up to ``max_distance`` pixels.
    ``smooth`` passes of a 3x3 mean follow on the filled cells.
    """
    raster = clean(raster)
    v = F.when(F.col("value").isNotNull(), F.struct(F.col("row").alias("r"), F.col("col").alias("c"), "value"))
    df = raster.withColumn("_v", v)
    lines = {"h": ([*LINE, "row"], "col"), "v": ([*LINE, "col"], "row"),
             "d": ([*LINE, F.col("row") - F.col("col")], "row"), "a": ([*LINE, F.col("row") + F.col("col")], "row")}
    for name, (keys, order) in lines.items():
        win = W.partitionBy(*keys).rowsBetween(W.unboundedPreceding, -1)
        df = df.withColumns({f"_{name}0": F.last("_v", ignorenulls=True).over(win.orderBy(order)),
                             f"_{name}1": F.last("_v", ignorenulls=True).over(win.orderBy(F.desc(order)))})
    num, den = F.lit(0.0), F.lit(0.0)
    for name in lines:
        for k in "01":
            c = F.col(f"_{name}{k}")
            dr, dc = F.col("row") - c["r"], F.col("col") - c["c"]
            d = F.sqrt((dr * dr + dc * dc).cast("double"))
            ok = c.isNotNull() & (d <= max_distance)
            num = num + F.when(ok, c["value"] / d).otherwise(0.0)
            den = den + F.when(ok, 1.0 / d).otherwise(0.0)
    hole = F.col("value").isNull()
    out = df.select(*LINE, "row", "col", hole.alias("was_hole"),
                    F.when(~hole, F.col("value")).when(den > 0, num / den).alias("value"))
    for _ in range(smooth):
        around = stencil(out.drop("was_hole"))
        cells = [F.col(s) for s in SIDES]
        total = sum([F.coalesce(c, F.lit(0.0)) for c in cells], F.lit(0.0))
        count = sum([c.isNotNull().cast("int") for c in cells], F.lit(0))
        mean = around.select(*LINE, "row", "col", (total / F.nullif(count, F.lit(0))).alias("_m"))
        out = out.join(mean, [*LINE, "row", "col"]).select(
            *LINE, "row", "col", "was_hole",
            F.when(F.col("was_hole") & F.col("value").isNotNull(), F.col("_m")).otherwise(F.col("value")).alias("value"))
    return out


def box_mean(raster: DataFrame, size: int = 15) -> DataFrame:
    """Mean of the valid cells in a square of ``size`` cells, rows first and then columns."""
    h = size // 2
    raster = clean(raster)
    across = W.partitionBy(*LINE, "row").orderBy("col").rangeBetween(-h, h)
    down = W.partitionBy(*LINE, "col").orderBy("row").rangeBetween(-h, h)
    df = raster.withColumns({"_s": F.sum("value").over(across), "_n": F.count("value").over(across)})
    df = df.withColumns({"_ss": F.sum("_s").over(down), "_nn": F.sum("_n").over(down)})
    return df.select(*LINE, "row", "col", "value", (F.col("_ss") / F.nullif(F.col("_nn"), F.lit(0))).alias("box"))


def median_smooth(raster: DataFrame, size: int = 3) -> DataFrame:
    """3x3 median over the valid cells of the neighbourhood; nodata stays nodata."""
    if size != 3:
        raise ValueError("only a 3x3 median is offered")
    around = stencil(raster)
    valid = F.array_sort(F.array_compact(F.array(*[F.col(s) for s in SIDES])))
    n = F.size("_a")
    mid = (F.get("_a", F.floor((n - 1) / 2).cast("int")) + F.get("_a", F.floor(n / 2).cast("int"))) / 2
    return around.withColumn("_a", valid).select(
        *LINE, "row", "col", F.when(F.col("value").isNotNull(), mid).alias("value"))
