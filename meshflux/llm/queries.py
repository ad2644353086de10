"""The registered queries of the subpackage and the SQL that must give the same rows."""

from __future__ import annotations

from importlib import import_module

#: Query name and the module that has it as ``query``, with ``SQL`` where SQL can express it.
MODULES = {
    "op5_exact_dedup": "exact_dedup",
    "op1_toxicity": "toxicity",
    "op2_token_counts": "token_files",
    "op3_license_scan": "license_scan",
    "op4_mixing": "mixing",
    "op6_decontaminate": "decontaminate",
    "op7_sequence_files": "sequence_files",
    "op8_simhash": "simhash",
    "op9_sharding": "sharding",
    "op10_kneser_ney": "kneser_ney",
    "op11_whitening": "whitening",
    "op12_conversation_repair": "conversations",
    "op13_minhash": "minhash",
}

QUERIES = {}
ORACLES = {}
for _name, _module in MODULES.items():
    _found = import_module(f"meshflux.llm.{_module}")
    QUERIES[_name] = _found.query
    if getattr(_found, "SQL", None):
        ORACLES[_name] = _found.SQL
