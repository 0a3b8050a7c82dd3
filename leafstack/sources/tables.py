"""Reading Parquet folders that may not be there yet, and naming what a stream of files takes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_or_empty(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The table at ``path``, empty if nothing has been written there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def stream_path(path: str) -> str:
    """A pattern for exactly this path: a stream takes only a folder by its plain name, but a pattern may also name one file."""
    plain = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{plain[:-1]}[{plain[-1]}]"
