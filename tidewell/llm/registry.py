"""The corpus operators' queries."""

from __future__ import annotations

import importlib

#: Modules with an ``op…`` query, in the order of their numbers.
MODULES = {
    "op1_token_files": "token_files",
    "op2_decontamination": "decontamination",
    "op3_html_text": "html_text",
    "op4_order_minhash": "near_dedup",
    "op5_bpe_round_trip": "bpe",
    "op6_additive_quantisation": "neighbours",
    "op7_warc_zip": "warc_zip",
    "op8_quality_rules": "quality",
    "op9_token_counts": "token_counts",
    "op10_secret_forest": "secrets",
    "op11_prefix_trie": "prefix_trie",
    "op12_importance_resampling": "resampling",
    "op13_language_bayes": "language_id",
}


def queries() -> dict:
    import corpus_pipeline

    found = {name: getattr(importlib.import_module(f"tidewell.llm.{module}"), name) for name, module in MODULES.items()}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline
    from tidewell.llm import prefix_trie, resampling

    found = {"op11_prefix_trie": prefix_trie.ORACLE_SQL, "op12_importance_resampling": resampling.ORACLE_SQL}
    return found if corpus_pipeline.ORACLE_SQL is None else found | {"pipeline": corpus_pipeline.ORACLE_SQL}
