"""The jobs as queries: each runs twice into one new folder and returns what is there after the second run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import passages, question_sheets
from leafstack import oracle, scratch


def job1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of all documents, taken as a stream of files; the second run finds nothing new."""
    folder = scratch.folder(spark, "job1", keep=True)
    for _ in range(2):
        passages.update(spark, f"{sf_dir}/documents.parquet", f"{folder}/out", f"{folder}/checkpoint")
    return passages.passages(spark, f"{folder}/out")


def job2_question_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt for every benchmark item, with passages of all documents."""
    folder = scratch.folder(spark, "job2", keep=True)
    for _ in range(2):
        question_sheets.build(spark, *(f"{sf_dir}/{t}.parquet" for t in ("documents", "benchmark", "embeddings")), folder, "benchmark")
    return question_sheets.read(spark, folder, "sheets")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_passages": job1_passages, "job2_question_sheets": job2_question_sheets}

SQL: dict[str, str] = {"job1_passages": oracle.passages("documents"), "job2_question_sheets": oracle.question_sheets()}
