"""Raw documents to packed training sequences: quality rules, near duplicates, secrets, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm import mixing, neardup, packing, quality, secrets
from loomery.llm.workspace import drop, materialize, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the isolation forest reject go."""
    return quality.passed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays."""
    return neardup.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Owner-specific live credentials are replaced by [kind]; every document stays."""
    return secrets.redact(docs.withColumn("_lm_repo", F.concat_ws("/", "source", "lang")), repo_col="_lm_repo").select(docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, stop or are cut where their source's budget says."""
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document with its place in a sequence. Workers that have run four stages keep few words."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), memo=100_000, batch=2**19)


STAGES = [
    ("quality", quality_rules),
    ("near_dedup", near_dedup),
    ("secrets", secret_scan),
    ("mixing", source_mix),
    ("packing", best_fit_packing),
]

#: Register estimates, the forest and the tokenizer have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written, and its input, goes once its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = materialize(stage(spark, docs, sf_dir), name)
            keep.append(docs)
        drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
