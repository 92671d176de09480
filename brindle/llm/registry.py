"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

import functools
import importlib

#: query name -> (module, SQL constant or None)
MODULES = {
    "op1_line_dedup": ("line_dedup", "OP1_SQL"),
    "op2_token_counts": ("tokens", None),
    "op3_sentencepiece": ("tokens", None),
    "op4_html_extraction": ("html_text", None),
    "op5_mixing": ("mixing", "OP5_SQL"),
    "op6_embedding_dedup": ("embedding_dedup", None),
    "op7_secret_scan": ("secrets", None),
    "op8_simhash": ("simhash", None),
    "op9_substring_dedup": ("substring_dedup", "OP9_SQL"),
    "op10_quality_rules": ("quality", None),
    "op11_token_alignment": ("alignment", None),
    "op12_language_model": ("language_model", None),
    "op13_merkle_manifest": ("merkle", "OP13_SQL"),
}


def _query(name: str, module: str):
    """The query, in a session whose Arrow batches suit very long texts."""
    from brindle.llm.common import small_batches

    run = getattr(importlib.import_module(f"brindle.llm.{module}"), name)

    @functools.wraps(run)
    def query(spark, sf_dir: str):
        small_batches(spark)
        return run(spark, sf_dir)

    return query


def queries() -> dict:
    return {n: _query(n, m) for n, (m, _) in MODULES.items()}


def oracle_sql() -> dict:
    return {n: getattr(importlib.import_module(f"brindle.llm.{m}"), s) for n, (m, s) in MODULES.items() if s}
