"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from tidemark.llm import oracles
from tidemark.llm.chat import op10_chat_formatting
from tidemark.llm.decontamination import op2_benchmark_decontamination
from tidemark.llm.embeddings import op5_embedding_dedup
from tidemark.llm.jaccard_join import op7_ngram_jaccard_join
from tidemark.llm.language import op8_language_id
from tidemark.llm.line_dedup import op4_line_dedup
from tidemark.llm.merkle import op13_merkle_manifest
from tidemark.llm.packing import op6_best_fit_packing
from tidemark.llm.pii import op11_pii
from tidemark.llm.quality import op1_quality_classifier
from tidemark.llm.spelling import op12_spelling_variants
from tidemark.llm.substring_dedup import op3_substring_dedup
from tidemark.llm.suffix_dedup import op9_suffix_dedup


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_classifier, op2_benchmark_decontamination, op3_substring_dedup, op4_line_dedup, op5_embedding_dedup, op6_best_fit_packing, op7_ngram_jaccard_join, op8_language_id, op9_suffix_dedup, op10_chat_formatting, op11_pii, op12_spelling_variants, op13_merkle_manifest)}


def oracle_sql() -> dict:
    """SQL of what SQL can express at the size of tests; tests hold the other operators against brute force."""
    return {"op3_substring_dedup": oracles.SUBSTRING, "op5_embedding_dedup": oracles.EMBEDDING, "op7_ngram_jaccard_join": oracles.JACCARD, "op9_suffix_dedup": oracles.SUFFIX, "op12_spelling_variants": oracles.SPELLING, "op13_merkle_manifest": oracles.MERKLE}
