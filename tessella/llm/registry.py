"""Queries of the training-data operators and their DuckDB oracles where SQL can express them."""

from __future__ import annotations

from tessella.llm import byte_pairs, decontaminate, fill_in_middle, jaccard_join, line_dedup, packing, pii, quality_classifier, quality_rules, secrets, sharding, suffix_dedup, vector_codes

QUERIES = {
    "op1_secret_scans": secrets.op1,
    "op2_line_dedup": line_dedup.op2,
    "op3_jaccard_join": jaccard_join.op3,
    "op4_sharding": sharding.op4,
    "op5_suffix_dedup": suffix_dedup.op5,
    "op6_packing": packing.op6,
    "op7_decontaminate": decontaminate.op7,
    "op8_quality_rules": quality_rules.op8,
    "op9_pii": pii.op9,
    "op10_quality_classifier": quality_classifier.op10,
    "op11_vector_codes": vector_codes.op11,
    "op12_fill_in_middle": fill_in_middle.op12,
    "op13_byte_pairs": byte_pairs.op13,
    "small_shards": sharding.small_shards,
}

ORACLES: dict[str, str] = {
    "op2_line_dedup": line_dedup.ORACLE,
    "op3_jaccard_join": jaccard_join.ORACLE,
    "op7_decontaminate": decontaminate.ORACLE,
    "op4_sharding": sharding.ORACLE,
    "small_shards": sharding.SMALL_ORACLE,
    "op5_suffix_dedup": suffix_dedup.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
    "op12_fill_in_middle": fill_in_middle.ORACLE,
}
