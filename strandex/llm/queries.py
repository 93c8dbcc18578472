"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from importlib import import_module

_NAMES = {
    "op1_chroma": "media",
    "op3_chat": "chat",
    "op6_html_text": "html_text",
    "op5_fingerprints": "spotsigs",
    "op8_sharding": "sharding",
    "op4_mixing": "mixing",
    "op7_toxicity": "toxicity",
    "op2_ngram_join": "ngram_join",
    "op9_packing": "packing",
    "op10_token_counts": "token_counts",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _NAMES.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, module in _NAMES.items():
        if sql := getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None):
            found[name] = sql
    return found
