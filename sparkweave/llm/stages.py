"""The stages of corpus_pipeline: one call of an operator each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkweave.llm import decontaminate, jaccard, mixing, sharding, toxicity
from sparkweave.llm.common import table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model takes for toxic go."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(toxicity.training_fold()))
    return toxicity.reject(docs, model)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies one row stays, of the least id."""
    return jaccard.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are cut or repeated to their targets."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its shard and its place in it."""
    return sharding.shuffle_documents(docs, "doc_id", shards=40)
