"""The corpus pipeline: quality, toxicity, near duplicates, mixing, tokens; each stage is one operator.

Every stage reads all rows of the one before, and fits on them; of the given tables only the first reads documents. Documents without an id pass the filters on their text alone. Null and empty texts are
scored by their statistics, have no shingles, size 0 and no tokens; very long texts are read whole; repeated rows score alike, and near_duplicates
keeps one of them; an empty table passes every stage as an empty table; columns beyond those named here, of any name and type, go with
their rows up to the last stage.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomtext.llm import bpe, jaccard, mixing, quality, toxicity
from loomtext.llm.common import materialize
from loomtext.llm.queries import table, vocabulary_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.filter_quality(docs, model)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic, by a model fitted on the labelled ones among them."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.filter_clean(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.deduplicate(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources say."""
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents with digests of their token ids and of the text that these decode to."""
    return bpe.round_trip(docs, vocabulary_path())


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: Trained models and BPE can't be said in SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
