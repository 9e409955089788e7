"""A training corpus from raw documents: good, distinct, clean of benchmarks and of personal data, tokenized."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from folioscan.llm.bpe import read_spec, round_trip_digests
from folioscan.llm.decontaminate import drop_contaminated
from folioscan.llm.jaccard_join import keep_one
from folioscan.llm.kneser_ney import keep_good
from folioscan.llm.queries import SURROGATE_KEY
from folioscan.llm.surrogates import replace_private
from folioscan.llm.workspace import materialize


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets become surrogates; n_chars follows."""
    return replace_private(docs, SURROGATE_KEY, length_col="n_chars" if "n_chars" in docs.columns else None)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them."""
    return round_trip_digests(docs, read_spec(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("quality_classifier", quality_classifier), ("jaccard_join", jaccard_join), ("decontamination", decontamination), ("pii", pii), ("bpe", bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents table, each reading what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None
