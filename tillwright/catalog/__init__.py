"""Every operator as a query over the given tables, each with an equivalent SQL text where SQL can say it."""

from __future__ import annotations

from importlib import import_module

from tillwright.catalog.base import ENTRIES, Entry

for _section in ("load", "profile", "kpi", "rollup", "segments", "anomaly", "investigation", "forecast", "backtest"):
    try:
        import_module(f"tillwright.catalog.{_section}")
    except ModuleNotFoundError as error:
        if error.name != f"tillwright.catalog.{_section}":
            raise

__all__ = ["ENTRIES", "Entry"]
