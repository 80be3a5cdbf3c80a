"""The query catalogue of the core: one module for each family, with QUERIES and ORACLES."""
from __future__ import annotations

import importlib
import pkgutil

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _m in sorted((m for m in pkgutil.iter_modules(__path__) if not m.name.startswith("_")), key=lambda m: m.name):
    _mod = importlib.import_module(f"{__name__}.{_m.name}")
    QUERIES |= getattr(_mod, "QUERIES", {})
    ORACLES |= getattr(_mod, "ORACLES", {})
