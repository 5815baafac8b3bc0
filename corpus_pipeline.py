"""The corpus pipeline: five operators, each on all that the one before has kept.

Stages take (spark, docs, sf_dir); docs has the columns of ``documents``, and so have the
results of all but the last, which returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphflow.llm.exact_dedup import drop_copies
from glyphflow.llm.minhash_join import drop_near_duplicates
from glyphflow.llm.mixing import apply_mix, label_domains
from glyphflow.llm.packing import pack
from glyphflow.llm.quality import filter_quality
from glyphflow.plans.staging import Workspace


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the rules reject go."""
    return filter_quality(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return drop_copies(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, that with the smallest doc_id."""
    return drop_near_duplicates(docs)


def target_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows by their fitted rates: toxic and poor text is thinned, good text kept."""
    return apply_mix(docs, label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in windows of 2048 tokens."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("target_mixing", target_mixing),
    ("packing", packing),
]

#: Mixing learns a classifier and packing needs a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``, each result written and read again."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = ws.keep(stage(spark, docs, sf_dir))
    return ws.finish(STAGES[-1][1](spark, docs, sf_dir))
