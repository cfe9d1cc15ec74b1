"""Training-data pipeline over ``documents``: language ID, near-dedup, substring dedup, mixing, packing.

Each stage is written as Parquet and read back as the next one's documents, in
the shared folder of the cluster, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelrisk.llm import stages
from panelrisk.session import cut_lineage
from panelrisk.sources.tables import table

STAGES = [
    ("language_id", stages.language_id),
    ("near_dedup", stages.near_dedup),
    ("substring_dedup", stages.substring_dedup),
    ("mix", stages.mix),
    ("pack", stages.pack),
]

#: trained models, sketches and a BPE vocabulary are beyond SQL: tests/llm compares the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
