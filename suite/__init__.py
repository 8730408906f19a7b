"""Registered queries over the sample tables."""

from __future__ import annotations

import importlib

MODULES = ["catalog", "workflow", "ingest", "functions", "features", "spatial", "analysis", "storage"]


def _load():
    from suite import registry
    for name in MODULES:
        importlib.import_module(f"suite.{name}")
    return registry


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLE)
