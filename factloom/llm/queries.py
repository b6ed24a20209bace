"""The opN_ queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import audit, brown, chat, forest, license, lloyd, mixing, packing, quality, search, simhash, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": license.op1_license_scan,
        "op2_source_mixing": mixing.op2_source_mixing,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_brown_lm": brown.op4_brown_lm,
        "op5_maxscore_topk": search.op5_maxscore_topk,
        "op6_simhash_groups": simhash.op6_simhash_groups,
        "op7_best_fit_packing": packing.op7_best_fit_packing,
        "op8_quality_classifier": quality.op8_quality_classifier,
        "op9_chat_perspectives": chat.op9_chat_perspectives,
        "op10_embedding_forest": forest.op10_embedding_forest,
        "op11_filter_audit": audit.op11_filter_audit,
        "op12_warc": warc.op12_warc,
        "op13_lloyd_codes": lloyd.op13_lloyd_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": license.oracle(),
        "op2_source_mixing": mixing.oracle(),
        "op5_maxscore_topk": search.ORACLE,
        "op9_chat_perspectives": chat.ORACLE,
        "op11_filter_audit": audit.ORACLE,
        "op12_warc": warc.ORACLE,
        "op13_lloyd_codes": lloyd.ORACLE,
    }
