"""Property extraction from metadata text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathline.functions import constants as K
from swathline.functions.scalars import nullif_empty

#: Prefixes that go before all others.
PREFIXES = ["drone-dji", "Camera", "MicaSense"]


def xmp_property(text: Column, name: str) -> Column:
    """A property as prefix:name="v", else <prefix:name>v<, else a bare name="v"; NULL when absent or blank.

    The known prefixes are looked for first, in their order, then any prefix.
    """
    forms = [f for p in [*PREFIXES, r"[\w-]+"] for f in (f'{p}:{name}="([^"]*)"', rf"<{p}:{name}(?:\s[^>]*)?>([^<]*)<")]
    forms.append(f'{name}="([^"]*)"')
    return F.coalesce(*[nullif_empty(F.trim(F.regexp_extract(text, f, 1))) for f in forms])


def xmp_extract(df: DataFrame, text: str = "xmp", props: Sequence[str] = tuple(K.ALL_PROPERTIES)) -> DataFrame:
    """One text column per property; those a query does not use are never computed."""
    return df.withColumns({p: xmp_property(F.col(text), p) for p in props})
