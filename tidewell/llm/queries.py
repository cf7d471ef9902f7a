"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from tidewell.llm import bpe, codes, kneser, licences, lm, media, mixing, neardup, negatives, pii, rules, substrings, tokenfiles

QUERIES = {
    "op1_byte_bpe": bpe.op1_byte_bpe,
    "op2_quality_classifier": kneser.op2_quality_classifier,
    "op3_quality_rules": rules.op3_quality_rules,
    "op4_licence_scan": licences.op4_licence_scan,
    "op5_media_columns": media.op5_media_columns,
    "op6_pii": pii.op6_pii,
    "op7_minhash_near_dedup": neardup.op7_minhash_near_dedup,
    "op8_lm_scoring": lm.op8_lm_scoring,
    "op9_suffix_array_dedup": substrings.op9_suffix_array_dedup,
    "op10_source_mixing": mixing.op10_source_mixing,
    "op11_vector_codes": codes.op11_vector_codes,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_token_files": tokenfiles.op13_token_files,
}
ORACLE_SQL = {"op3_quality_rules": rules.OP3_SQL, "op11_vector_codes": codes.OP11_SQL, "op12_hard_negatives": negatives.OP12_SQL}
