"""The queries of this package, and SQL for those that SQL can express."""

from . import chunking, decontaminate, langid, mixing, pii, quality, scoring, sharding, simhash, suffix

QUERIES = {
    "op1_suffix_dedup": suffix.op1_suffix_dedup,
    "op2_language_id": langid.op2_language_id,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_lm_scoring": scoring.op5_lm_scoring,
    "op6_pii": pii.op6_pii,
    "op7_sharding": sharding.op7_sharding,
    "op8_substring_dedup": chunking.op8_substring_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op10_simhash": simhash.op10_simhash,
}

ORACLES = {"op3_quality_rules": quality.ORACLE, "op4_decontaminate": decontaminate.ORACLE}
