"""The thin queries of the training-data operators: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from importlib import import_module

#: Query name: the module that holds it.
_WHERE = {
    "op1_vafile_topk": "vafile",
    "op2_warc_index": "warc",
    "op3_pack_sequences": "packing",
    "op4_mix_sources": "mixing",
    "op5_substring_dedup": "substring",
    "op6_stupid_backoff": "lm",
    "op7_quality_rules": "quality",
    "op8_simhash_components": "simhash",
    "op9_toxicity": "toxicity",
    "op10_pii_spans": "pii",
    "op11_fill_in_middle": "infill",
    "op12_collocations": "collocation",
    "op13_url_rules": "urlrules",
}


def _run(module: str):
    return lambda spark, sf_dir: import_module(f"{__package__}.{module}").query(spark, sf_dir)


QUERIES = {name: _run(module) for name, module in _WHERE.items()}
ORACLE = {name: sql for name, module in _WHERE.items() if (sql := getattr(import_module(f"{__package__}.{module}"), "ORACLE", None))}
