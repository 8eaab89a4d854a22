"""All queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict = {}
for _name in ("mojibake", "copies", "sentences", "pieces", "lookalikes", "tokenize", "leaks", "truncation"):
    try:
        _m = importlib.import_module(f"textloom.llm.{_name}")
    except ModuleNotFoundError as e:
        if e.name != f"textloom.llm.{_name}":
            raise
        continue
    QUERIES.update(_m.QUERIES)
    ORACLES.update(_m.ORACLES)
