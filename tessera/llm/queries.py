"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, jaccard, language_id, language_model, periods, pieces, quality, spelling, suffix_array, suffix_tree, token_files, topk, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": suffix_tree.op1_substring_dedup,
    "op2_ngram_jaccard": jaccard.op2_ngram_jaccard,
    "op3_topk_search": topk.op3_topk_search,
    "op4_lm_scoring": language_model.op4_lm_scoring,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_suffix_array_dedup": suffix_array.op6_suffix_array_dedup,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_language_id": language_id.op8_language_id,
    "op9_quality": quality.op9_quality,
    "op10_sentencepiece": pieces.op10_sentencepiece,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_token_files": token_files.op12_token_files,
    "op13_periodic_runs": periods.op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": suffix_tree.ORACLE,
    "op2_ngram_jaccard": jaccard.ORACLE,
    "op3_topk_search": topk.ORACLE,
    "op6_suffix_array_dedup": suffix_array.ORACLE,
    "op11_spelling_variants": spelling.ORACLE,
}
