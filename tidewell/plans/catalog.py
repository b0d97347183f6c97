"""All query modules of the library, imported once."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES, Query

#: Modules whose import registers queries.
MODULES: list[str] = ["q_assoc", "q_charts", "q_importance", "q_profile", "q_rows", "q_series", "q_sources", "q_sql", "q_text"]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"tidewell.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return QUERIES


def oracles() -> dict[str, str]:
    _load()
    return ORACLES
