"""The corpus pipeline: stages over the documents table, each reading what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkweave.llm import stages
from sparkweave.llm.common import stage_table, table

STAGES = [
    ("toxicity", stages.reject_toxic),
    ("ngram_jaccard_join", stages.keep_one_of_each_group),
    ("benchmark_decontamination", stages.drop_contaminated),
    ("mixing", stages.mix_sources),
    ("sharding", stages.shard),
]

#: Several stages (learned scores, random walks, keyed random orders) have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
