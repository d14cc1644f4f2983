"""The queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: query: module of the function that has its name, and of its SQL if any
MODULES = {
    "op1_license_scan": "licenses",
    "op2_language_id": "language",
    "op3_warc_index": "warc",
    "op4_minhash_near_dup": "near_dup",
    "op5_chat_format": "chat",
    "op6_byte_bpe": "bpe",
    "op7_media_chunks": "media",
    "op8_private_data": "pii",
    "op9_exact_top_k": "topk",
    "op10_best_fit_packing": "packing",
    "op11_impact_search": "lexical",
    "op12_rendezvous_shards": "shards",
    "op13_prefix_trie": "trie",
}

_found = {name: import_module(f"corpusloom.llm.{module}") for name, module in MODULES.items()}

QUERIES = {name: getattr(module, name) for name, module in _found.items()}

SQL: dict[str, str] = {name: module.SQL for name, module in _found.items() if hasattr(module, "SQL")}
