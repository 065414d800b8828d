"""The corpus operators' queries by name, and their SQL where SQL can say it."""

from __future__ import annotations

from millrace.llm import alignment, ann, bpe, decontamination, divergence, fingerprints, lm, mixing, neardup, passages, pii, quality, substrings

QUERIES = {
    "op1_ann_collisions": ann.op1_ann_collisions,
    "op2_minhash_odd_sketch": neardup.op2_minhash_odd_sketch,
    "op3_suffix_dedup": substrings.op3_suffix_dedup,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_lm_scores": lm.op5_lm_scores,
    "op6_fingerprints": fingerprints.op6_fingerprints,
    "op7_substring_dedup": passages.op7_substring_dedup,
    "op8_pii": pii.op8_pii,
    "op9_quality": quality.op9_quality,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_token_alignment": alignment.op12_token_alignment,
    "op13_decontamination": decontamination.op13_decontamination,
}

ORACLE_SQL = {
    "op2_minhash_odd_sketch": neardup.OP2_SQL,
    "op3_suffix_dedup": substrings.OP3_SQL,
    "op7_substring_dedup": passages.OP7_SQL,
    "op10_mix_sources": mixing.OP10_SQL,
    "op11_source_divergence": divergence.OP11_SQL,
    "op13_decontamination": decontamination.OP13_SQL,
}
