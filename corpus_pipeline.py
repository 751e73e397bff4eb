"""The corpus pipeline: quality rules, near-duplicates, benchmark passages, source mixing, token shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorelake.llm.common import stored, table
from scorelake.llm.quality_rules import quality_stage
from scorelake.llm.simhash_groups import near_dedup
from scorelake.llm.source_mixing import mixed
from scorelake.llm.spaced_seeds import decontaminated
from scorelake.llm.token_shards import token_output


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_stage(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_output(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_shards", token_shards),
]

# Fingerprints, seeds and token ids have no SQL form; test_run_against_plain_python compares the run's rows with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
