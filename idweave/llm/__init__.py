"""Operators of a large-scale training-data pipeline.

Each module holds one operator with a general interface on DataFrames and the thin query
that applies it to its whole table.  ``queries()`` and ``oracle_sql()`` collect them.
"""

from __future__ import annotations

from importlib import import_module

#: query name -> (module, function)
QUERIES = {
    "op1_language_id": ("language_id", "query"),
    "op2_suffix_dedup": ("suffix_dedup", "query"),
    "op3_bpe_codec": ("bpe_codec", "query"),
    "op4_quality_classifier": ("quality_classifier", "query"),
    "op5_html_extraction": ("html_extraction", "query"),
    "op6_fingerprints": ("fingerprints", "query"),
    "op7_best_fit_packing": ("packing", "query"),
    "op8_jaccard_join": ("jaccard_join", "query"),
    "op9_quality_rules": ("quality_rules", "query"),
    "op10_url_filters": ("url_filters", "query"),
    "op11_conversation_repair": ("conversation_repair", "query"),
    "op12_secret_scan": ("secret_scan", "query"),
    "op13_spelling_variants": ("spelling_variants", "query"),
}


#: all modules are loaded with the subpackage: where one of them can't be, the subpackage can't
MODULES = {name: import_module(f"{__name__}.{module}") for name, (module, _) in QUERIES.items()}


def queries():
    """name -> function(spark, sf_dir) of every operator of this subpackage."""
    return {name: getattr(MODULES[name], function) for name, (_, function) in QUERIES.items()}


def oracle_sql():
    """name -> DuckDB SQL, where SQL can express the operator."""
    return {name: module.ORACLE_SQL for name, module in MODULES.items() if getattr(module, "ORACLE_SQL", None)}
