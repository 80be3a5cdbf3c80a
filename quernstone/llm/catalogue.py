"""Queries and oracle SQL of this folder's operators."""
from __future__ import annotations

import importlib

MODULES = ("grouped_splits", "reply_defects", "cross_split", "split_boundaries", "consensus", "leakage", "mixing", "truncation")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _m = importlib.import_module(f"quernstone.llm.{_name}")
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
