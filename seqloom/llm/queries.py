"""The queries of this subpackage's operators, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

#: Query name -> module of this subpackage with query(spark, sf_dir) and, where it exists, SQL.
MODULES = {
    "op1_chat_format": "chat_format",
    "op2_token_pack": "token_pack",
    "op3_rank_bpe": "rank_bpe",
    "op4_simhash": "simhash",
    "op5_toxicity": "toxicity",
    "op6_lang_id": "lang_id",
    "op7_exact_dedup": "exact_dedup",
    "op8_url_filter": "url_filter",
    "op9_mixing": "mixing",
    "op10_quality": "quality",
}


def _module(name: str):
    return importlib.import_module(f"{__package__}.{MODULES[name]}")


def queries() -> dict:
    return {name: _module(name).query for name in MODULES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name in MODULES if (sql := getattr(_module(name), "SQL", None))}
