"""All queries of the library by name, with the SQL that checks them where SQL can express them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("plans.filtering", "plans.aggregation", "plans.joining", "plans.lineage", "plans.readiness", "plans.corpus", "plans.platform", "plans.scripts", "plans.upkeep", "plans.calibrating", "plans.scanning")

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = import_module(f"weftline.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
