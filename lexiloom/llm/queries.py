"""The registered queries of this subpackage and their DuckDB forms, where SQL has one."""

from __future__ import annotations

from importlib import import_module

_MODULES = {
    "op1_simhash": "simhash",
    "op2_chat_tree": "chat",
    "op3_secrets": "secrets",
    "op4_html_template": "html_template",
    "op5_bpe": "bpe",
    "op6_line_windows": "lines",
    "op7_suffix_repeats": "suffix",
    "op8_repair_ids": "repair",
    "op9_decontaminate": "decontaminate",
    "op10_quality": "quality",
    "op11_resample": "resample",
    "op12_token_counts": "piece_counts",
    "op13_source_audit": "divergence",
}


def queries() -> dict:
    import corpus_pipeline

    found = {name: getattr(import_module(f".{module}", __package__), name) for name, module in _MODULES.items()}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {}
    for name, module in _MODULES.items():
        sql = getattr(import_module(f".{module}", __package__), "ORACLE_SQL", None)
        if sql:
            found[name] = sql
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
