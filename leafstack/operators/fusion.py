"""Reciprocal rank fusion of search legs, and the hybrid search it completes."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafstack.config import DEFAULTS, Settings
from leafstack.operators.dense import dense_topk
from leafstack.operators.ranking import best
from leafstack.operators.sparse import sparse_topk


def reciprocal_rank_fusion(legs: list[DataFrame], query: str, ident: str, k: int = DEFAULTS.rrf_k) -> DataFrame:
    """query, ident, score double (6 decimals): the sum of 1 / (k + rank) over the legs that found the row."""
    together = reduce(DataFrame.unionByName, [leg.select(query, ident, "rank") for leg in legs])
    return together.groupBy(query, ident).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 6).alias("score"))


def fused_ranks(ranks: Iterable[tuple[str, int]], limit: int, k: int = DEFAULTS.rrf_k) -> list[tuple[str, float]]:
    """The same for the few (ident, rank) that the legs of one question gave: the best ``limit`` with their scores."""
    scores: dict[str, float] = {}
    for ident, rank in ranks:
        scores[ident] = scores.get(ident, 0.0) + 1.0 / (k + rank)
    return sorted(((i, round(x, 6)) for i, x in scores.items()), key=lambda x: (-x[1], x[0]))[:limit]


def only_documents(df: DataFrame, column: str, doc_ids: list | None) -> DataFrame:
    """Rows of the named documents; no list and an empty list mean all."""
    return df.where(F.col(column).isin(*doc_ids)) if doc_ids else df


def hybrid_search(
    index: DataFrame,
    vectors: DataFrame,
    questions: DataFrame,
    query_vectors: DataFrame,
    total: int,
    ident: str,
    query: str,
    text: Column,
    limit: int | None = None,
    doc_ids: list | None = None,
    doc_column: str | None = None,
    s: Settings = DEFAULTS,
) -> DataFrame:
    """query, ident, score, rank: dense and sparse legs of ``prefetch_k`` rows each, fused, the best ``limit`` of each query.

    The filter is applied inside every leg, before ranking, where Parquet can use it.
    """
    column = doc_column or ident
    among = F.col(column).isin(*doc_ids) if doc_ids else None
    sparse = sparse_topk(index, questions, total, ident, query, text, s.prefetch_k, among)
    dense = dense_topk(only_documents(vectors, column, doc_ids), query_vectors, ident, query, k=s.prefetch_k)
    return best(reciprocal_rank_fusion([dense, sparse], query, ident, s.rrf_k), query, ident, limit or s.top_k)


def sources(hits: DataFrame, payload: DataFrame, query: str, ident: str) -> DataFrame:
    """Hits with their payload: n from 1, score with 4 decimals, empty text for a missing section or text."""
    n = F.row_number().over(Window.partitionBy(query).orderBy("rank"))
    joined = hits.join(payload, ident, "left").withColumn("n", n).withColumn("score", F.round("score", 4))
    for c in ("section", "text"):
        if c in joined.columns:
            joined = joined.withColumn(c, F.coalesce(c, F.lit("")))
    return joined.drop("rank")
