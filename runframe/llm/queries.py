"""The registered queries of the text operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, fingerprint, jaccard, langid, lines, media, mixing, packing, phrases, sharding, spelling, tokencount, toxicity

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_token_counts": tokencount.op3_token_counts,
    "op4_media_columns": media.op4_media_columns,
    "op5_ngram_jaccard": jaccard.op5_ngram_jaccard,
    "op6_mixing": mixing.op6_mixing,
    "op7_fingerprints": fingerprint.op7_fingerprints,
    "op8_line_dedup": lines.op8_line_dedup,
    "op9_sharding": sharding.op9_sharding,
    "op10_packing": packing.op10_packing,
    "op11_phrases": phrases.op11_phrases,
    "op12_chat": chat.op12_chat,
    "op13_spelling": spelling.op13_spelling,
}

ORACLE_SQL = {"op5_ngram_jaccard": jaccard.SQL, "op8_line_dedup": lines.SQL, "op11_phrases": phrases.SQL, "op12_chat": chat.SQL}
