"""The corpus queries by name, and the SQL that says the same, where SQL can."""

from __future__ import annotations

from importlib import import_module

NAMES = {
    "op1_minhash_near_dedup": "op1_minhash",
    "op2_sharding": "op2_sharding",
    "op3_exact_topk": "op3_topk",
    "op4_pii": "op4_pii",
    "op5_sentencepiece": "op5_sentencepiece",
    "op6_language_id": "op6_language",
    "op7_best_fit_packing": "op7_packing",
    "op8_url_filters": "op8_urls",
    "op9_exact_dedup": "op9_exact",
    "op10_substring_dedup": "op10_substring",
    "op11_fill_in_middle": "op11_infill",
    "op12_centroid_clustering": "op12_centroids",
    "op13_embedding_near_dedup": "op13_lattice",
}
_MODULES = {name: import_module(f".{module}", __package__) for name, module in NAMES.items()}
QUERIES = {name: module.query for name, module in _MODULES.items()}
ORACLES = {name: module.ORACLE for name, module in _MODULES.items() if getattr(module, "ORACLE", None)}
