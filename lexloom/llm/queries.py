"""The queries of this folder's operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from . import digest, forest, jaccard, language_model, mixing, packing, rollups, substrings, toxicity, warc

QUERIES = {
    "op1_mixing": mixing.query,
    "op2_warc": warc.query,
    "op3_substrings": substrings.query,
    "op4_packing": packing.query,
    "op5_jaccard": jaccard.query,
    "op6_forest": forest.query,
    "op7_token_counts": rollups.query,
    "op8_digest": digest.query,
    "op9_toxicity": toxicity.query,
    "op10_language_model": language_model.query,
}

ORACLE_SQL: dict[str, str] = {"op2_warc": warc.SQL, "op7_token_counts": rollups.SQL}
