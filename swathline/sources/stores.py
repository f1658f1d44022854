"""Band manifests, raster tiles and reports on storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swathline.functions import constants as K
from swathline.operators.grid import LINE, tile_of


def manifest_write(images: DataFrame, path: str) -> None:
    """Images under one folder per band, one JSON line each (the manifest's file list); beside them ``_manifest``, a JSON line
    per band with its number of images, and ``_datasets``, a JSON line per dataset with its number of images, bands, manufacturer,
    model and whether it is multispectral (``manifest_rebuild``; only where ``images`` has the columns that it needs).

    A column that has no value at all is not in the lines; ``manifest_datasets`` gives NULL there.  The counts are taken from the
    written lines, so ``images`` is worked out once.
    """
    images.write.mode("overwrite").partitionBy("band").json(path)
    used = [c for c in images.columns if c in ("band", "dataset_id", "folder_no", "file_path", "manufacturer", "drone_model")]
    lines = images.sparkSession.read.schema(images.select(*used).schema).json(path)
    lines.groupBy("band").agg(F.count("*").alias("images")).write.mode("overwrite").json(f"{path}/_manifest")
    if {"dataset_id", "folder_no", "file_path", "manufacturer", "drone_model"} <= set(images.columns):
        manifest_rebuild(lines).write.mode("overwrite").json(f"{path}/_datasets")


def manifest_read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def manifest_datasets(spark: SparkSession, path: str, dataset_id: str = "string") -> DataFrame:
    """One row per dataset of a written manifest; ``dataset_id`` is the type of that column."""
    return spark.read.schema(f"dataset_id {dataset_id}, total_images long, bands array<string>, manufacturer string, drone_model string, "
                             "is_multispectral boolean").json(f"{path}/_datasets")


def manifest_rebuild(parts: DataFrame) -> DataFrame:
    """Merge per-folder partial manifests (dataset_id, folder_no, band, file_path, manufacturer, drone_model).

    The last folder that knows the manufacturer or model decides; any band but rgb, even ``unknown``, makes
    the dataset multispectral.
    """

    def last_known(col: str) -> Column:
        known = F.when(F.col(col).isNotNull() & (F.col(col) != "unknown"), F.struct("folder_no", "file_path"))
        return F.max_by(col, known).alias(col)

    return parts.groupBy("dataset_id").agg(
        F.count("*").alias("total_images"),
        F.array_sort(F.collect_set("band")).alias("bands"),  # at most the nine band names
        F.coalesce(last_known("manufacturer"), F.lit("unknown")).alias("manufacturer"), last_known("drone_model"),
        F.bool_or(F.col("band") != "rgb").alias("is_multispectral"))


def to_tiles(raster: DataFrame, block: int = K.TILE, level: int = 1) -> DataFrame:
    """Pixels -> one row per tile with the positions and values it holds (nodata left out).

    A tile has at most block x block pixels, so a row is bounded whatever the raster's size.
    """
    pos = (F.col("row") % block) * block + F.col("col") % block
    tagged = raster.where(F.col("value").isNotNull()).withColumns(tile_of(block))
    if "level" not in tagged.columns:
        tagged = tagged.withColumn("level", F.lit(level))
    px = F.array_sort(F.collect_list(F.struct(pos.cast("int").alias("pos"), "value")))
    tiles = tagged.groupBy(*LINE, "level", "tr", "tc").agg(px.alias("px"))
    return tiles.select(*LINE, "level", "tr", "tc", F.col("px.pos").alias("pos"), F.col("px.value").alias("data"))


def from_tiles(tiles: DataFrame, block: int = K.TILE) -> DataFrame:
    px = tiles.select(*LINE, "level", "tr", "tc", F.explode(F.arrays_zip("pos", "data")).alias("p"))
    return px.select(*LINE, "level", (F.col("tr") * block + F.floor(F.col("p.pos") / block)).cast("int").alias("row"),
                     (F.col("tc") * block + F.col("p.pos") % block).cast("int").alias("col"), F.col("p.data").alias("value"))


def tiles_write(raster: DataFrame, path: str, block: int = K.TILE) -> None:
    """Tiles as Parquet, one folder per band and level, sorted by raster and tile for range pruning.

    Rasters share folders: there may be as many as there are images.
    """
    order = ["band", "level", "raster_id", "tr", "tc"]
    (to_tiles(raster, block).repartitionByRange(*order).sortWithinPartitions(*order)
     .write.mode("overwrite").partitionBy("band", "level").parquet(path))


def tiles_read(spark: SparkSession, path: str, bands: Sequence[str] | None = None, level: int | None = None,
               bbox: tuple[int, int, int, int] | None = None, block: int = K.TILE) -> DataFrame:
    """Pixels back from tiles; ``bbox`` is (row0, col0, row1, col1), inclusive.

    Bands and levels prune folders; the box prunes tiles inside the files before any pixel is unpacked.
    """
    tiles = spark.read.parquet(path)
    if bands:
        tiles = tiles.where(F.col("band").isin(list(bands)))
    if level is not None:
        tiles = tiles.where(F.col("level") == level)
    if bbox:
        r0, c0, r1, c1 = bbox
        tiles = tiles.where(F.col("tr").between(r0 // block, r1 // block) & F.col("tc").between(c0 // block, c1 // block))
    out = from_tiles(tiles, block)
    if bbox:
        out = out.where(F.col("row").between(r0, r1) & F.col("col").between(c0, c1))
    return out


def report_write(summary: DataFrame, path: str) -> None:
    """Summary rows as JSON lines."""
    summary.write.mode("overwrite").json(path)
