"""Queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from importlib import import_module

#: query name -> module of this subpackage that defines it
WHERE = {
    "op1_pivots": "pivots",
    "op2_token_orc": "token_orc",
    "op3_secrets": "secrets",
    "op4_topk": "bitslice",
    "op5_lm": "lm",
    "op6_pii": "pii",
    "op7_mixing": "mixing",
    "op8_simhash": "simhash",
    "op9_packing": "packing",
    "op10_toxicity": "toxicity",
    "op11_runs": "runs",
    "op12_repeats": "repeats",
    "op13_divergence": "divergence",
}
QUERIES = {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in WHERE.items()}
ORACLE_SQL = {
    "op4_topk": import_module(f"{__package__}.bitslice").ORACLE,
    "op13_divergence": import_module(f"{__package__}.divergence").ORACLE,
}
