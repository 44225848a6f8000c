"""Registered queries."""

from __future__ import annotations

import importlib

from .registry import CATALOG, Entry

MODULES = ("log_queries", "state_queries", "rule_queries", "page_queries", "tree_queries", "stream_queries")


def load_catalog() -> dict[str, Entry]:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return CATALOG
