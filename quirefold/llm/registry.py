"""Queries of this folder, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from quirefold.llm import byte_bpe, context_tree, decontaminate, language_id, line_dedup, ngram_join, quality_classifier, quality_rules, suffix_dedup, tool_calls

QUERIES = {
    "op1_decontaminate": decontaminate.query,
    "op2_byte_bpe": byte_bpe.query,
    "op3_suffix_dedup": suffix_dedup.query,
    "op4_language_id": language_id.query,
    "op5_quality_classifier": quality_classifier.query,
    "op6_quality_rules": quality_rules.query,
    "op7_line_dedup": line_dedup.query,
    "op8_ngram_join": ngram_join.query,
    "op9_tool_calls": tool_calls.query,
    "op10_context_tree": context_tree.query,
}
ORACLE = {
    "op6_quality_rules": quality_rules.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op8_ngram_join": ngram_join.ORACLE,
    "op9_tool_calls": tool_calls.ORACLE,
}
