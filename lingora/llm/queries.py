"""Queries and SQL of this subpackage, for the registry of the repository's entry module."""

from lingora.llm import bpe, chat, decontaminate, hard_negatives, jaccard, line_dedup, piece_bpe, pu_quality, quality_rules, substring, suffix_dedup, toxicity, whitening

QUERIES = {
    "op1_pu_quality": pu_quality.op1_pu_quality,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_piece_bpe": piece_bpe.op11_piece_bpe,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_whitening": whitening.op13_whitening,
    "op2_ngram_jaccard": jaccard.op2_ngram_jaccard,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_chat_format": chat.op6_chat_format,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_substring_dedup": substring.op8_substring_dedup,
    "op9_quality_rules": quality_rules.op9_quality_rules,
}
ORACLES = {
    "op12_hard_negatives": hard_negatives.ORACLE_SQL,
    "op2_ngram_jaccard": jaccard.ORACLE_SQL,
    "op5_line_dedup": line_dedup.ORACLE_SQL,
    "op6_chat_format": chat.ORACLE_SQL,
    "op7_suffix_dedup": suffix_dedup.ORACLE_SQL,
    "op8_substring_dedup": substring.ORACLE_SQL,
}
