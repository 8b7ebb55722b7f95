"""Documents to token shards in five stages, each written as Parquet and read again by the next.

Quality rules reject, near duplicates leave one row a group, documents with benchmark passages go, sources are
mixed to target weights, and the rest is written as a token archive and read back. All stages but the last keep
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from incidentry.llm import decontaminate, mixing, ngram_join, quality_rules
from incidentry.llm.queries import token_rows
from incidentry.plans.catalog import scratch

#: What the mixing stage makes of the present expected tokens of the domains clean, low and toxic.
MIX_FACTORS = (1.0, 0.5, 0.25)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    return quality_rules.apply_policy(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram join."""
    return ngram_join.keep_one(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of benchmark words."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rates say."""
    return mixing.remix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), MIX_FACTORS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document of the token archive: doc_id, start, n_tokens and ids_crc32."""
    return token_rows(spark, docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", tokens),
]

#: The mixing stage fits a classifier and iterates, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
