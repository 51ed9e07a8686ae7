"""The training-data pipeline: quality rules, near-duplicates, decontamination, personal data, packing.

Each stage reads what its predecessor wrote to the shared folder, so a lost executor costs at most
one stage's tasks.  All stages but the last keep the columns of ``documents``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from freightline.llm.common import materialise, release
from freightline.llm.decontam import decontamination_stage
from freightline.llm.neardup import dedup_stage
from freightline.llm.packing import packing_stage
from freightline.llm.pii import pii_stage
from freightline.llm.quality import quality_stage

STAGES = [
    ("quality_rules", quality_stage),
    ("minhash_near_dedup", dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("pii_surrogates", pii_stage),
    ("best_fit_packing", packing_stage),
]

#: Signatures, tokenisation and keyed surrogates have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(*before)  # the output of the stage before this one
        before = [docs]
    return docs
