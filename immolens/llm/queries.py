"""The operators' queries, by name, with DuckDB SQL where it can express them."""

from __future__ import annotations

from immolens.llm import (byte_bpe, chat, decontaminate, divergence, langid, licenses, packing,
                          quality_rules, simhash, spelling, suffix_dedup, token_files, toxicity)

#: query name -> the operator's module; its ORACLE_SQL is the query's SQL, if it has one
REGISTERED = {
    "op1_language_id": langid,
    "op2_chat_format": chat,
    "op3_quality_rules": quality_rules,
    "op4_simhash_dedup": simhash,
    "op5_toxicity": toxicity,
    "op6_suffix_dedup": suffix_dedup,
    "op7_license_scan": licenses,
    "op8_token_output": token_files,
    "op9_packing": packing,
    "op10_decontamination": decontaminate,
    "op11_source_divergence": divergence,
    "op12_spelling_variants": spelling,
    "op13_byte_bpe": byte_bpe,
}

QUERIES = {name: module.query for name, module in REGISTERED.items()}
ORACLE_SQL = {name: module.ORACLE_SQL for name, module in REGISTERED.items()
              if hasattr(module, "ORACLE_SQL")}
