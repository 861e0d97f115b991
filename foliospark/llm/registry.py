"""The corpus queries and their SQL, for the entry module."""

from __future__ import annotations

from foliospark.llm import chat, decontaminate, langid, licenses, mixing, ngram_join, pii, quality, spelling, substrings, tokencount, toxicity, whitening

QUERIES = {
    "op1_quality_rules": quality.op1,
    "op2_decontamination": decontaminate.op2,
    "op3_substring_dedup": substrings.op3,
    "op3_whole_units": substrings.op3_whole,
    "op4_license_scan": licenses.op4,
    "op5_ngram_join": ngram_join.op5,
    "op6_language_id": langid.op6,
    "op7_chat_format": chat.op7,
    "op8_pii": pii.op8,
    "op9_token_counts": tokencount.op9,
    "op10_mixing": mixing.op10,
    "op11_spelling_variants": spelling.op11,
    "op12_toxicity": toxicity.op12,
    "op13_whitening": whitening.op13,
}
ORACLES = {
    "op1_quality_rules": quality.OP1_SQL,
    "op3_substring_dedup": substrings.OP3_SQL,
    "op4_license_scan": licenses.OP4_SQL,
    "op5_ngram_join": ngram_join.OP5_SQL,
    "op10_mixing": mixing.OP10_SQL,
    "op11_spelling_variants": spelling.OP11_SQL,
}
