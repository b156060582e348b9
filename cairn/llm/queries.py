"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

#: Query name -> module of this subpackage that defines it, and the name of its SQL there, if any.
_WHERE = {
    "op1_toxicity": ("toxicity", None),
    "op2_lm_scoring": ("lm", None),
    "op3_topk": ("topk", "OP3_SQL"),
    "op4_decontamination": ("decontam", "OP4_SQL"),
    "op5_pii": ("pii", None),
    "op6_url_filter": ("urls", "OP6_SQL"),
    "op7_near_dedup": ("neardup", None),
    "op8_secret_scan": ("secret_scan", None),
    "op9_mixing": ("mixing", "OP9_SQL"),
    "op10_suffix_dedup": ("suffix_dedup", "OP10_SQL"),
}


def _module(name: str):
    return importlib.import_module(f"cairn.llm.{name}")


def queries() -> dict:
    return {q: getattr(_module(m), q) for q, (m, _) in _WHERE.items()}


def oracle_sql() -> dict[str, str]:
    return {q: getattr(_module(m), sql) for q, (m, sql) in _WHERE.items() if sql}
