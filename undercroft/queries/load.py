"""Imports every query module once."""

from __future__ import annotations

import importlib

MODULES = ("functions", "journal", "intervals", "neighbours", "targets", "evaluation", "panels", "rules",
           "serving", "merges", "sources", "streams", "learning")


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"undercroft.queries.{name}")
