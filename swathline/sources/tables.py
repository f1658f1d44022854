"""Readers for small survey text files: marks, control points, spectra, poses, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swathline.functions.ranking import bucketed_row_number
from swathline.functions.scalars import nullif_empty

SPECTRA_IDS = ("id", "sample", "index", "name")
INDEX_IDS = ("id", "plot_id", "point_id", "sample_id")


def _with_line_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A number that grows with the position in the file: file, block start, then row order in the block."""
    return df.select(
        *columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row")).withColumn("line_no", F.struct("_file", "_block", "_row")).drop(
        "_file", "_block", "_row")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return _with_line_numbers(spark.read.text(path), ["value"])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, header=True)
    return _with_line_numbers(df, df.columns)


def mrk_parse(lines: DataFrame) -> DataFrame:
    """Mark lines (value, line_no) -> seq, lat, lon, alt; a later line replaces an earlier one.

    Tagged tokens ``v,Lat v,Lon v,Ellh`` are preferred; otherwise plain numbers after the sequence number and
    the date and time tokens.
    """
    line = F.trim("value")
    parts = F.split(F.regexp_replace(line, r"\s+", " "), " ")
    df = lines.where((line != "") & ~line.startswith("#") & ~line.startswith(";")).select("line_no", line.alias("line"), parts.alias("p"))
    df = df.withColumn("idx", F.col("p")[0].try_cast("int")).where("idx IS NOT NULL")

    def tagged(tag: str) -> Column:
        return nullif_empty(F.regexp_extract("line", rf"([\d.]+),{tag}", 1)).try_cast("double")

    df = df.withColumns({"_a": tagged("Lat"), "_o": tagged("Lon"), "_h": tagged("Ellh")})
    is_tagged = F.col("_a").isNotNull() & F.col("_o").isNotNull() & F.col("_h").isNotNull()
    start = F.when(F.coalesce(F.get("p", F.lit(1)), F.lit("")).rlike(r"^\d{4}[/-]\d{2}[/-]\d{2}$"), 3).otherwise(2)

    def plain(i: int) -> Column:
        return F.get("p", start + i).try_cast("double")

    ok = is_tagged | (plain(0).isNotNull() & plain(1).isNotNull() & plain(2).isNotNull())
    df = df.where(ok).select(
        "line_no", F.when(F.col("idx") < 10000, F.lpad(F.col("idx").cast("string"), 4, "0")).otherwise(
            F.col("idx").cast("string")).alias("seq"),
        F.struct(F.when(is_tagged, F.col("_a")).otherwise(plain(0)).alias("lat"),
                 F.when(is_tagged, F.col("_o")).otherwise(plain(1)).alias("lon"),
                 F.when(is_tagged, F.col("_h")).otherwise(plain(2)).alias("alt")).alias("pos"))
    return df.groupBy("seq").agg(F.max_by("pos", "line_no").alias("pos")).select("seq", "pos.*")


def mrk_read(spark: SparkSession, path: str) -> DataFrame:
    return mrk_parse(read_lines(spark, path))


def gcp_parse(table: DataFrame) -> DataFrame:
    """Control points with header columns; the id is id, else point_id, else name; the last duplicate wins."""
    have = {c.lower(): c for c in table.columns}
    ids = [nullif_empty(F.col(have[c])) for c in ("id", "point_id", "name") if c in have]
    z = F.col(have["z"]).try_cast("double") if "z" in have else F.lit(None).cast("double")
    rows = table.select("line_no", F.coalesce(*ids).alias("id"), F.struct(
        F.col(have["x"]).try_cast("double").alias("x"), F.col(have["y"]).try_cast("double").alias("y"), z.alias("z")).alias("p"))
    return rows.groupBy("id").agg(F.max_by("p", "line_no").alias("p")).select("id", "p.*")


def gcp_read(spark: SparkSession, path: str) -> DataFrame:
    return gcp_parse(read_table(spark, path))


def spectra_long(table: DataFrame, id_cols: Sequence[str] = SPECTRA_IDS, lower_names: bool = False,
                 lines_per_bucket: int = 65536) -> DataFrame:
    """Wide samples -> band, ordinal, value.

    Cells that are not numbers are skipped, and the ordinal counts the parsed ones of a band in line order.
    ``line_no`` may be a number or the struct of ``read_table``.
    """
    bands = [c for c in table.columns if c != "line_no" and c.lower() not in id_cols]
    pairs = F.array(*[F.struct(F.lit(c.lower() if lower_names else c).alias("band"),
                               F.col(f"`{c}`").cast("string").alias("text")) for c in bands])
    long = table.select("line_no", F.explode(pairs).alias("p")).select(
        "line_no", "p.band", F.trim("p.text").try_cast("double").alias("value")).where("value IS NOT NULL")
    if dict(long.dtypes)["line_no"].startswith("struct"):
        bucket = F.struct("line_no._file", "line_no._block", F.floor(F.col("line_no._row") / lines_per_bucket).alias("b"))
    else:
        bucket = F.floor(F.col("line_no") / lines_per_bucket)
    return bucketed_row_number(long, ["band"], ["line_no"], bucket).select("band", "ordinal", "value")


def spectra_read(spark: SparkSession, path: str, id_cols: Sequence[str] = SPECTRA_IDS, lower_names: bool = False) -> DataFrame:
    return spectra_long(read_table(spark, path), id_cols, lower_names)


def poses_parse(lines: DataFrame) -> DataFrame:
    """Camera pose lines of at least nine tokens: id, (name), quaternion 2-5, translation 6-8."""
    p = F.split(F.regexp_replace(F.trim("value"), r"\s+", " "), " ")
    rows = lines.where(~F.trim("value").startswith("#")).select("line_no", p.alias("p")).where(F.size("p") >= 9)
    names = ["qw", "qx", "qy", "qz", "tx", "ty", "tz"]
    out = rows.select("line_no", F.col("p")[0].alias("image_id"),
                      *[F.col("p")[2 + i].try_cast("double").alias(n) for i, n in enumerate(names)])
    return out.dropna(subset=names)


def poses_read(spark: SparkSession, path: str) -> DataFrame:
    return poses_parse(read_lines(spark, path))


STATS_SCHEMA = ("outputs map<string, struct<width: int, height: int, crs: string, size_mb: double, bands: int, "
                "geotransform: array<double>>>")


def stats_rows(stats: DataFrame) -> DataFrame:
    """One row per output of a statistics document, with resolution in cm and band names."""
    rows = stats.select(F.explode("outputs").alias("file", "info"))
    n = F.col("info.bands")
    return rows.select(
        F.regexp_replace("file", r"\.tif", "").alias("type"),
        F.round(F.abs(F.get("info.geotransform", F.lit(1))) * 100, 4).alias("resolution_cm"),
        F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("band_"), i.cast("string")))).alias("bands"),
        "info.width", "info.height", "info.crs", "info.size_mb")


def stats_read(spark: SparkSession, path: str) -> DataFrame:
    return stats_rows(spark.read.schema(STATS_SCHEMA).json(path, multiLine=True))
