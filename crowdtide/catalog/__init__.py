"""All registered queries."""

from __future__ import annotations

import importlib

MODULES = ("cleaning", "series", "crowd", "live", "schedules", "calibration", "models", "forecast", "streams", "documents")


def load() -> tuple[dict, dict]:
    from crowdtide.catalog.base import ORACLES, QUERIES

    for name in MODULES:
        importlib.import_module(f"crowdtide.catalog.{name}")
    return dict(QUERIES), dict(ORACLES)
