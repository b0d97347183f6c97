"""The queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import bpe, chat_format, exact_dedup, html_text, language, near_dedup, packing, quality, ranked, repair, sharding, suffix_dedup, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": warc.op1_warc,
        "op2_sharding": sharding.op2_sharding,
        "op4_bpe": bpe.op4_bpe,
        "op3_suffix_array_dedup": suffix_dedup.op3_suffix_array_dedup,
        "op5_html_extraction": html_text.op5_html_extraction,
        "op7_language_id": language.op7_language_id,
        "op6_quality_rules": quality.op6_quality_rules,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_packing": packing.op9_packing,
        "op10_minhash_near_dedup": near_dedup.op10_minhash_near_dedup,
        "op11_chat_format": chat_format.op11_chat_format,
        "op12_ranked_search": ranked.op12_ranked_search,
        "op13_structure_repair": repair.op13_structure_repair,
        "pipeline": corpus_pipeline.run,
    }


def oracles() -> dict[str, str]:
    return {"op1_warc": warc.OP1_SQL, "op8_exact_dedup": exact_dedup.OP8_SQL, "op11_chat_format": chat_format.OP11_SQL, "op12_ranked_search": ranked.OP12_SQL}
