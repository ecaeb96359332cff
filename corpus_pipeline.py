"""A training-data pipeline over ``documents``: quality classifier, line dedup, near-duplicate join,
benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is stored as Parquet in the
shared folder and read again as the next one's ``docs``. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veritrail.llm import bpe, decontaminate, jaccard_join, line_dedup, quality_crf
from veritrail.llm.shared import stored

STAGES = [
    ("quality_classifier", quality_crf.stage),
    ("line_dedup", line_dedup.stage),
    ("ngram_jaccard_join", jaccard_join.stage),
    ("benchmark_decontamination", decontaminate.stage),
    ("bpe_encoding", bpe.stage),
]

#: A trained classifier and BPE cannot be expressed in SQL; tests/llm compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
