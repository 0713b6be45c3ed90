"""All corpus queries with their oracle SQL, gathered from the query modules."""

from __future__ import annotations

import importlib

MODULES = ("op1_media", "op2_toxicity", "op3_packing", "op4_language", "op5_simhash", "op6_mixing", "op7_topk", "op8_warc", "op9_sharding", "op10_substrings", "op11_whitening", "op12_alignment", "op13_html", "pipeline")

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _name in MODULES:
    _module = importlib.import_module(f"dayloom.llm.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(getattr(_module, "ORACLE_SQL", {}))
