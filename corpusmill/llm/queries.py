"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from importlib import import_module

#: query name -> module of this subpackage that holds it
MODULES = {
    "op1_decontaminate": "op1_decontaminate",
    "op2_bpe": "op2_bpe",
    "op3_jaccard": "op3_jaccard",
    "op4_media": "op4_media",
    "op5_html": "op5_html",
    "op6_tokens": "op6_tokens",
    "op7_substrings": "op7_substrings",
    "op8_toxicity": "op8_toxicity",
    "op9_quality": "op9_quality",
    "op10_pii": "op10_pii",
    "media_clips": "op4_media",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items() if name == module}
    return {name: sql for name, sql in found.items() if sql}
