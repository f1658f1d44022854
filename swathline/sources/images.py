"""Image listings, file classes and dataset layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swathline.functions import constants as K
from swathline.functions.scalars import lookup

# fixed values: file extensions accepted from an archive, by class
ARCHIVE_IMAGES = ["jpg", "jpeg", "png", "tiff", "tif", "webp", "bmp", "gif", "dng"]
ARCHIVE_METADATA = ["nav", "obs", "mrk", "bin", "pos", "csv", "txt", "log", "rtcm", "ubx", "rinex", "json", "xml"]


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r".\.([^.]*)$", 1))


def select_images(catalogue: DataFrame) -> DataFrame:
    """Files with an image extension, sorted by path."""
    return catalogue.where(extension(F.col("path")).isin(K.IMAGE_EXTENSIONS)).orderBy("path")


def scan_images(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Image files under ``root``, sorted by path; only names and sizes are read, not contents."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
             .select("path", "length", "modificationTime"))
    return select_images(files)


def classify_files(catalogue: DataFrame) -> DataFrame:
    """Keep image and metadata files of an archive listing, with their class and a cleaned path."""
    path = F.regexp_replace("path", r"\\", "/")
    ext = extension(path)
    kind = F.when(ext.isin(ARCHIVE_IMAGES), "IMAGE").when(ext.isin(ARCHIVE_METADATA), "METADATA")
    clean = F.array_join(F.filter(F.split(path, "/"), lambda p: ~p.isin("..", ".")), "/")
    keep = kind.isNotNull() & ~F.col("path").startswith("__MACOSX") & ~file_name(F.col("path")).startswith(".")
    return catalogue.where(keep).withColumns({"file_type": kind, "clean_path": clean})


def detect_layout(catalogue: DataFrame) -> DataFrame:
    """Per dataset (root, path below it): images, image folders, ground truth and reference files, sensors.

    File lists come from rows of their own kind; images only count, so a folder of millions stays one number.
    """
    name, ext = F.lower(file_name(F.col("path"))), extension(F.col("path"))
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    product = F.lit(False)
    for word in K.REFERENCE_PRODUCT_WORDS:
        product = product | file_name(F.col("path")).contains(word)
    tagged = catalogue.select(
        "root", "path", F.when(folder == "", ".").otherwise(folder).alias("folder"),
        ext.isin(K.IMAGE_EXTENSIONS).alias("is_image"), name.isin(K.GROUND_TRUTH_FILES).alias("is_truth"),
        product.alias("is_product"))
    # duplicates of a folder are merged before the lists are made
    per_dir = tagged.where("is_image").groupBy("root", "folder").agg(F.count("*").alias("n"))
    per_dir = per_dir.withColumn("sensors", F.array_compact(F.array(*[
        F.when(F.lower("folder").contains(hint), sensor) for hint, sensor in K.SENSOR_HINTS.items()])))
    dirs = per_dir.groupBy("root").agg(
        F.sum("n").alias("image_count"), F.count("*").alias("image_dirs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("sensors")))).alias("sensors"))
    files = tagged.groupBy("root").agg(F.count_if("is_truth").alias("ground_truth_files"),
                                       F.count_if("is_product").alias("reference_products"))
    return files.join(dirs, "root", "left").fillna(0, ["image_count", "image_dirs"]).withColumn(
        "sensors", F.coalesce("sensors", F.array().cast("array<string>")))


def layout_files(catalogue: DataFrame) -> DataFrame:
    """The ground-truth and reference files themselves, one row each."""
    name = F.lower(file_name(F.col("path")))
    product = F.lit(False)
    for word in K.REFERENCE_PRODUCT_WORDS:
        product = product | file_name(F.col("path")).contains(word)
    kinds = F.array_compact(F.array(F.when(name.isin(K.GROUND_TRUTH_FILES), "ground_truth"), F.when(product, "reference")))
    return catalogue.select("root", "path", F.explode(kinds).alias("kind"))


def content_type(catalogue: DataFrame) -> DataFrame:
    """MIME type by extension, with the class's fallback."""
    known = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "tif": "image/tiff", "tiff": "image/tiff",
             "webp": "image/webp", "bmp": "image/bmp", "gif": "image/gif", "csv": "text/csv", "txt": "text/plain",
             "json": "application/json", "xml": "text/xml"}
    ext = extension(F.col("path"))
    other = F.when(F.col("file_type") == "METADATA", "application/octet-stream").otherwise(F.concat(F.lit("image/"), ext))
    return catalogue.withColumn("content_type", lookup(ext, known, other))
