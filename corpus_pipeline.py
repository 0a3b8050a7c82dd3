"""The cleaning pipeline over ``documents``: each stage works on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafstack.llm import cuckoo_dedup, decontaminate, near_duplicates, speculative_bpe, toxicity
from leafstack.llm._common import documents, written
from leafstack.llm.queries import TOKENIZER, TOXIC, toxicity_model


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labelled rows of ``docs``."""
    return toxicity.accepted(docs, toxicity_model(spark, docs, sf_dir), threshold=TOXIC)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one that stays."""
    return cuckoo_dedup.without_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates (five-word shingles, similarity 0.8), the document with the smallest id."""
    return near_duplicates.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of ids, and the digests of ids and decoded text, of every document that is left."""
    return speculative_bpe.round_trip(docs, speculative_bpe.tokenizer_file(TOKENIZER), keep=("doc_id",))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("SimHash near-dedup", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("BPE encoding and decoding", tokenized),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot express the classifier, the fingerprints or the merges.
ORACLE_SQL = None
