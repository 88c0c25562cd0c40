"""Queries of the subpackage by name, and SQL where it can express them."""

from __future__ import annotations

from . import (
    conversation_repair, decontamination, fingerprints, jaccard, language_model, lexical_search, packing, pii, sharding,
    substring_dedup, token_counts, token_store, toxicity,
)

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_sharding": sharding.query,
    "op3_language_model": language_model.query,
    "op4_jaccard": jaccard.query,
    "op5_decontamination": decontamination.query,
    "op6_token_store": token_store.query,
    "op7_token_counts": token_counts.query,
    "op8_packing": packing.query,
    "op9_pii": pii.query,
    "op10_fingerprints": fingerprints.query,
    "op11_lexical_search": lexical_search.query,
    "op12_substring_dedup": substring_dedup.query,
    "op13_conversation_repair": conversation_repair.query,
}
SQL: dict[str, str] = {
    "op11_lexical_search": lexical_search.SQL,
    "op12_substring_dedup": substring_dedup.SQL,
    "op13_conversation_repair": conversation_repair.SQL,
}
