"""Queries of the corpus operators, by name, with SQL for two of them; tests hold the others against brute force."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from photolake.llm import ann, bpe, chat, lbl, ngram_join, oracles, packing, quality, repair, rules, spelling, suffixes, toxicity, wrappers


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        wrappers.op1_html_extraction,
        toxicity.op2_toxicity,
        ngram_join.op3_ngram_jaccard_join,
        bpe.op4_bpe,
        chat.op5_chat_formatting,
        quality.op6_quality_classifier,
        suffixes.op7_suffix_array_dedup,
        ann.op8_permutation_index,
        rules.op9_quality_rules,
        packing.op10_best_fit_packing,
        lbl.op11_lm_scoring,
        spelling.op12_spelling_variants,
        repair.op13_conversation_repair,
        pipeline,
    )
}

ORACLE_SQL: dict[str, str] = {"op12_spelling_variants": oracles.SPELLING, "op13_conversation_repair": oracles.REPAIR}
