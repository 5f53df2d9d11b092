"""The queries of this subpackage and the SQL that checks them, for ``__spark_entry__``."""

from __future__ import annotations

from atomloom.llm import chat_format, jaccard_join, lexical_search, license_scan, line_dedup, merkle_manifest, packing, piece_codec, quality_rules, sharding, token_files, topk_search, toxicity

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_chat_format": chat_format.op3_chat_format,
    "op4_topk_search": topk_search.op4_topk_search,
    "op5_packing": packing.op5_packing,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_token_files": token_files.op7_token_files,
    "op8_sentencepiece": piece_codec.op8_sentencepiece,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_lexical_search": lexical_search.op11_lexical_search,
    "op12_merkle_manifest": merkle_manifest.op12_merkle_manifest,
    "op13_sharding": sharding.op13_sharding,
}
ORACLES = {
    "op1_license_scan": license_scan.ORACLE,
    "op2_quality_rules": quality_rules.ORACLE,
    "op3_chat_format": chat_format.ORACLE,
    "op4_topk_search": topk_search.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op11_lexical_search": lexical_search.ORACLE,
    "op12_merkle_manifest": merkle_manifest.ORACLE,
    "op13_sharding": sharding.ORACLE,
}
