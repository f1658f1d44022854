from __future__ import annotations

import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from swathline.session import build_session  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[*]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
        "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def raster_rows(bands: dict[str, np.ndarray], raster_id: str = "r") -> list[tuple]:
    out = []
    for band, arr in bands.items():
        for r in range(arr.shape[0]):
            for c in range(arr.shape[1]):
                v = float(arr[r, c])
                out.append((raster_id, band, r, c, None if np.isnan(v) else v))
    return out


RASTER = "raster_id string, band string, row int, col int, value double"


@pytest.fixture
def make_raster(spark):
    def make(bands: dict[str, np.ndarray], raster_id: str = "r"):
        return spark.createDataFrame(raster_rows(bands, raster_id), RASTER)
    return make


def to_array(df, shape, band=None, col="value", fill=np.nan):
    out = np.full(shape, fill)
    for r in df.collect():
        if band is None or r["band"] == band:
            v = r[col]
            out[r["row"], r["col"]] = np.nan if v is None else v
    return out
