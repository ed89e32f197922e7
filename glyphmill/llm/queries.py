"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from glyphmill.llm import bpe, language, lm, mixing, mpeg, quality, simhash, suffixes, topk, toxicity


def queries() -> dict:
    return {
        "op1_quality_classifier": quality.op1,
        "op2_mix_sources": mixing.op2,
        "op3_suffix_dedup": suffixes.op3,
        "op4_bpe_encoding": bpe.op4,
        "op5_simhash_near_dedup": simhash.op5,
        "op6_lm_backoff": lm.op6,
        "op7_mpeg_audio": mpeg.op7,
        "op8_toxicity": toxicity.op8,
        "op9_exact_top_k": topk.op9,
        "op10_language_id": language.op10,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return {
        "op2_mix_sources": mixing.ORACLE,
        "op6_lm_backoff": lm.ORACLE,
        "op9_exact_top_k": topk.ORACLE,
    }
