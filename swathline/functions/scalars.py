"""Column helpers: rounding, parsing, text keys."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rounded(col: Column | str, places: int = 6) -> Column:
    """Round for comparison; adding zero turns -0.0 into 0.0."""
    return F.round(col, places) + F.lit(0.0)


def rounded_off_tie(col: Column | str) -> Column:
    """Round to 6 places after a small shift, for values such as means of prices that fall on ties."""
    c = F.col(col) if isinstance(col, str) else col
    return rounded(c + F.lit(137e-9))


def lookup(col: Column, table: Mapping[str, object], default: Column | None = None) -> Column:
    """Look a value up in a small fixed table, as a literal map (no join)."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.create_map(*pairs)[col]
    return found if default is None else F.coalesce(found, default)


def number(col: Column | str) -> Column:
    """NULL instead of an error when the text is not a number."""
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(c).try_cast("double")


def positive(col: Column | str, default: float) -> Column:
    n = number(col)
    return F.when(n > 0, n).otherwise(F.lit(default))


def float_list(col: Column | str) -> Column:
    """Comma separated (else blank separated) floats; any bad entry gives an empty list."""
    c = F.trim(F.col(col) if isinstance(col, str) else col)
    parts = F.when(c.contains(","), F.split(c, ",")).otherwise(F.split(c, " "))
    kept = F.filter(F.transform(parts, F.trim), lambda x: x != "")
    values = F.transform(kept, lambda x: x.try_cast("double"))
    bad = F.exists(values, lambda x: x.isNull())
    return F.when(c.isNull() | (c == "") | bad, F.array().cast("array<double>")).otherwise(values)


def nullif_empty(col: Column) -> Column:
    return F.when(col != "", col)


def capture_seq(name: Column | str, pattern: str = r"_(\d{4})_") -> Column:
    """4-digit exposure number embedded in a file name, NULL when absent."""
    return nullif_empty(F.regexp_extract(name, pattern, 1))


def dms_to_dd(df: DataFrame, default_altitude: float = 100.0) -> DataFrame:
    """Degrees, minutes, seconds with hemisphere letters -> signed degrees and altitude.

    Reads lat_d, lat_m, lat_s, lat_ref, lon_d, lon_m, lon_s, lon_ref, alt, alt_ref.
    """

    def signed(axis: str) -> Column:
        size = F.col(f"{axis}_d") + F.col(f"{axis}_m") / 60.0 + F.col(f"{axis}_s") / 3600.0
        return F.when(F.col(f"{axis}_ref").isin("S", "W"), -size).otherwise(size)

    altitude = F.coalesce(F.col("alt").cast("double"), F.lit(default_altitude))
    return df.withColumns({
        "lat": signed("lat"),
        "lon": signed("lon"),
        "altitude": F.when(F.col("alt_ref") == 1, -altitude).otherwise(altitude),
    })


def settle(df: DataFrame, *cols: str) -> DataFrame:
    """Compute ``cols`` once per row, ahead of a filter on them.

    Spark moves a filter below the projection that makes its columns and repeats their expressions there;
    long formulas then outgrow one generated method.  A one-element generator keeps the filter above.
    """
    rest = [c for c in df.columns if c not in cols]
    return df.select(*rest, F.inline(F.array(F.struct(*cols))))


def exact_sum(col: Column | str, places: int = 6) -> Column:
    """Order-free sum: add decimals, return double."""
    c = F.col(col) if isinstance(col, str) else col
    return F.sum(c.cast(f"decimal(30,{places})")).cast("double")
