"""Loads every module that registers queries."""

from __future__ import annotations

import importlib

MODULES = ["business", "rasters", "imaging", "survey", "streams"]


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"swathline.plans.{m}")
