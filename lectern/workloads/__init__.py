"""Registered queries over the driver tables."""

from __future__ import annotations

import importlib

MODULES = ("texts", "corpus", "selecting", "models", "labeling", "prompting", "streams", "storage", "traffic")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"lectern.workloads.{name}")


def all_queries() -> dict:
    from lectern.workloads.base import QUERIES

    _load()
    return dict(QUERIES)


def all_sql() -> dict:
    from lectern.workloads.base import ORACLES

    _load()
    return dict(ORACLES)
