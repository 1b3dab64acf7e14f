"""Registered queries over the given tables, each with its SQL counterpart where one exists."""

from __future__ import annotations

from importlib import import_module

from loadscope.catalog.registry import ORACLES, QUERIES

_MODULES = ("serving", "steps", "traces", "datasets", "arrivals", "sweeps", "files")

for _name in _MODULES:
    import_module(f"loadscope.catalog.{_name}")

__all__ = ["ORACLES", "QUERIES"]
