"""The library's operators run over the supplied tables, each with its SQL twin where one exists."""

from __future__ import annotations

import importlib

MODULES = ("feed", "text", "stories", "rounds", "activity", "pages", "labels", "payloads", "reads",
           "streams", "collected")


def load() -> dict:
    """name -> Query, in module order."""
    from wirefold.workload.base import QUERIES
    for name in MODULES:
        importlib.import_module(f"wirefold.workload.{name}")
    return QUERIES
