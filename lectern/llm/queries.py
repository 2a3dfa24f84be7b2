"""All queries of this subpackage, with the SQL of those that have one."""

from __future__ import annotations

import importlib

from lectern.llm.common import ORACLES, QUERIES

MODULES = (
    "bpe", "packing", "near_dedup", "line_dedup", "warc", "toxicity", "quality", "vectors", "codes", "lm_score", "alignment", "substrings", "turns",
)

for _name in MODULES:
    importlib.import_module(f"lectern.llm.{_name}")

__all__ = ["ORACLES", "QUERIES"]
