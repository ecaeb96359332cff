"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann_aq, bpe, conversation_repair, decontaminate, hard_negatives, jaccard_join, line_dedup, packing, quality_crf, sharding, suffix_dedup, toxicity_fm, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_crf": quality_crf.query,
        "op2_extendible_sharding": sharding.query,
        "op3_warc_archive": warc.query,
        "op4_bpe_codec": bpe.query,
        "op5_line_dedup": line_dedup.query,
        "op6_suffix_dedup": suffix_dedup.query,
        "op7_decontaminate": decontaminate.query,
        "op8_toxicity_fm": toxicity_fm.query,
        "op9_ngram_jaccard": jaccard_join.query,
        "op10_ann_aq": ann_aq.query,
        "op11_hard_negatives": hard_negatives.query,
        "op12_packing": packing.query,
        "op13_conversation_repair": conversation_repair.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_extendible_sharding": sharding.ORACLE,
        "op3_warc_archive": warc.ORACLE,
        "op5_line_dedup": line_dedup.ORACLE,
        "op7_decontaminate": decontaminate.ORACLE,
        "op10_ann_aq": ann_aq.ORACLE,
        "op11_hard_negatives": hard_negatives.ORACLE,
        "op13_conversation_repair": conversation_repair.ORACLE,
    }
