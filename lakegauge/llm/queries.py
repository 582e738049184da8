"""The registered queries of this package and the SQL each must equal, where SQL can express it."""

from __future__ import annotations

from lakegauge.llm import (chat, cleaning, decontaminate, mixing, near, negatives, passages, personal, suffix_tree, suffixes,
                           warc, whitening, winnowing)

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_personal_data": personal.op3_personal_data,
    "op4_near_duplicates": near.op4_near_duplicates,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_shared_passages": passages.op6_shared_passages,
    "op7_suffix_dedup": suffixes.op7_suffix_dedup,
    "op8_chat": chat.op8_chat,
    "op9_quality_rules": cleaning.op9_quality_rules,
    "op10_suffix_tree_scores": suffix_tree.op10_suffix_tree_scores,
    "op11_fingerprints": winnowing.op11_fingerprints,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_whiten": whitening.op13_whiten,
}

ORACLES = {
    "op1_warc": warc.ORACLE,
    "op2_decontaminate": decontaminate.ORACLE,
    "op4_near_duplicates": near.ORACLE,
    "op8_chat": chat.ORACLE,
    "op9_quality_rules": cleaning.ORACLE,
    "op11_fingerprints": winnowing.ORACLE,
    "op12_hard_negatives": negatives.ORACLE,
}
