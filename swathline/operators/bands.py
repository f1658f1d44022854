"""Which band an image holds, and which sensor family made it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathline.functions import constants as K
from swathline.functions.scalars import lookup


def manufacturer(make: Column, drone_model: Column, software: Column, model: Column) -> Column:
    def has(word: str) -> Column:
        return make.contains(word) | drone_model.contains(word) | software.contains(word)

    return (F.when(has("dji"), "dji").when(has("micasense"), "micasense")
            .when(model.contains("rededge") | model.contains("altum"), "micasense")
            .when(make.contains("parrot"), "parrot").otherwise("unknown"))


def _lowered(col: str) -> Column:
    return F.lower(F.coalesce(F.col(col), F.lit("")))


def _by_suffix(stem: Column, table: dict[str, str]) -> tuple[Column, Column]:
    """(band, suffix) of the longest suffix the name ends in."""
    ordered = sorted(table, key=lambda s: -len(s))
    band, hit = F.lit(None).cast("string"), F.lit(None).cast("string")
    for suffix in reversed(ordered):
        ends = F.upper(stem).endswith(suffix.upper())
        band = F.when(ends, table[suffix]).otherwise(band)
        hit = F.when(ends, suffix).otherwise(hit)
    return band, hit


def band_classify(meta: DataFrame) -> DataFrame:
    """Band of each image by its metadata, else its file name, else its colour mode.

    Reads file_name, band_name, make, model, software, drone_model, colour_mode (any but file_name may be NULL).
    """
    df = meta.withColumn("manufacturer", manufacturer(
        _lowered("make"), _lowered("drone_model"), _lowered("software"), _lowered("model")))
    low = F.lower(F.trim("band_name"))
    dji = lookup(low, {k.lower(): v for k, v in K.DJI_BAND_NAMES.items()})
    mica = lookup(low, {k.lower(): v for k, v in K.MICASENSE_BAND_NAMES.items()})
    by_name = F.coalesce(F.when(F.col("manufacturer") == "micasense", mica), dji, mica)
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    d_band, d_hit = _by_suffix(stem, K.DJI_SUFFIXES)
    g_band, g_hit = _by_suffix(stem, K.GENERIC_SUFFIXES)
    df = df.withColumns({"_name": by_name, "_d": d_band, "_dh": d_hit, "_g": g_band, "_gh": g_hit})
    colour = F.coalesce(F.col("colour_mode").isin(K.COLOUR_MODES), F.lit(False))
    return df.withColumns({
        "band": F.coalesce("_name", "_d", "_g", F.when(colour, "rgb").otherwise("unknown")),
        "method": (F.when(F.col("_name").isNotNull(), "xmp_band_name")
                   .when(F.col("_d").isNotNull(), F.concat(F.lit("filename_pattern="), "_dh"))
                   .when(F.col("_g").isNotNull(), F.concat(F.lit("filename_pattern=generic"), "_gh"))
                   .when(colour, F.concat(F.lit("channel_heuristic=channel_mode="), "colour_mode"))
                   .when(F.col("colour_mode").isNotNull(),
                         F.concat(F.lit("channel_heuristic=single_channel_mode="), "colour_mode"))
                   .otherwise("channel_heuristic=fallback")),
        "confidence": (F.when(F.col("_name").isNotNull(), 0.95)
                       .when(F.col("_d").isNotNull() | F.col("_g").isNotNull(), 0.80)
                       .when(colour, 0.50).otherwise(0.30))}).drop("_name", "_d", "_dh", "_g", "_gh")


def processor_select(df: DataFrame) -> DataFrame:
    """Sensor family: the first rule whose text is in the model name, else the manufacturer's default."""
    key = F.lower(F.trim("drone_model"))
    family = F.lit(None).cast("string")
    for pattern, name in reversed(K.SENSOR_FAMILY_RULES):
        family = F.when(key.contains(pattern), name).otherwise(family)
    fallback = lookup(F.lower(F.trim("manufacturer")), K.MANUFACTURER_FAMILY)
    return df.withColumn("sensor_family", F.coalesce(family, fallback))
