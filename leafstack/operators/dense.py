"""Exact and two-phase nearest vectors by cosine.

A block of stated queries is sent to the vectors, never the reverse: each batch of vectors is scored against the block by
matrix products, and only the best of a task leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafstack.config import DEFAULTS
from leafstack.functions.vectors import dot, int8_codes, l2_normalize
from leafstack.operators.ranking import Best as _Best
from leafstack.operators.ranking import best

#: Queries in one block, for each of which the vectors are read once; their vectors are what is broadcast.
QUERY_BLOCK = 8192
#: Queries that are scored by one matrix product.
_AT_ONCE = 512


def dense_topk(vectors: DataFrame, queries: DataFrame, ident: str, query: str, vector: str = "embedding", k: int = DEFAULTS.prefetch_k) -> DataFrame:
    """query, ident, score double (6 decimals), rank int: the ``k`` nearest of each query.

    ``queries`` (query, vector) is read by the driver in blocks of ``QUERY_BLOCK``, as a set that a request states; there
    is no score threshold, so every query gets rows while there are vectors.
    """
    blocks, held, kind = [], [], dict(queries.dtypes)[query]
    for row in queries.select(query, vector).toLocalIterator():
        held.append((row[0], row[1]))
        if len(held) == QUERY_BLOCK:
            blocks.append(_block(vectors, held, kind, ident, query, vector, k))
            held = []
    if held or not blocks:
        blocks.append(_block(vectors, held, kind, ident, query, vector, k))
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b)
    return best(out, query, ident, k)


def stated_topk(vectors: DataFrame, asked: dict[str, list[float]], ident: str, query: str, vector: str = "embedding", k: int = DEFAULTS.prefetch_k) -> DataFrame:
    """As ``dense_topk``, for a few queries that are at hand."""
    return best(_block(vectors, list(asked.items()), "string", ident, query, vector, k), query, ident, k)


def _block(vectors: DataFrame, held: list, query_type: str, ident: str, query: str, vector: str, k: int) -> DataFrame:
    names = np.array([q for q, _ in held])
    matrix = _unit(np.array([v for _, v in held], np.float64)) if held else np.zeros((0, 1))
    schema = f"`{query}` {query_type}, `{ident}` {dict(vectors.dtypes)[ident]}, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_Best(k) for _ in range(0, len(names), _AT_ONCE)]
        kind = None
        for whole in batches:
            for x in range(0, whole.num_rows if len(names) else 0, 4096):
                b = whole.slice(x, 4096)
                rows = _unit(b.column(vector).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1))
                ids, kind = np.array(b.column(ident).to_pylist()), b.column(ident).type
                for i, best_of in enumerate(held):
                    best_of.add(np.round(matrix[i * _AT_ONCE : (i + 1) * _AT_ONCE] @ rows.T, 6), ids)
        for i, best_of in enumerate(held if kind is not None else []):
            q, found, scores = best_of.rows()
            yield pa.RecordBatch.from_arrays([pa.array(names[i * _AT_ONCE + q]), pa.array(found, kind), pa.array(scores)], names=[query, ident, "score"])

    return vectors.select(ident, vector).where(F.col(vector).isNotNull()).mapInArrow(run, schema)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm == 0, 1, norm)


def with_codes(vectors: DataFrame, vector: str = "embedding", codes: str = "codes") -> DataFrame:
    """``vectors`` with int8 codes to be stored beside them: a byte for each component, an eighth of a double."""
    return vectors.withColumn(codes, int8_codes(l2_normalize(F.col(vector))))


def two_phase_topk(coded: DataFrame, queries: DataFrame, ident: str, query: str, vector: str = "embedding", k: int = 10, coarse: int = 100, codes: str = "codes") -> DataFrame:
    """As ``dense_topk``, but the stored codes choose ``coarse`` candidates, and only those are scored with the full vectors.

    ``coded`` has the columns of ``with_codes``. The first phase reads the codes alone.
    """
    asked = queries.select(query, F.col(vector).alias(codes))
    near = dense_topk(coded, asked, ident, query, codes, coarse).select(query, ident)
    asked = queries.select(query, l2_normalize(F.col(vector)).alias("_q"))
    full = near.join(coded.select(ident, F.col(vector).alias("_raw")), ident).select(query, ident, l2_normalize(F.col("_raw")).alias("_v")).join(asked, query)
    return best(full.select(query, ident, F.round(dot(F.col("_v"), F.col("_q")), 6).alias("score")), query, ident, k)


def cosine(a: Column, b: Column) -> Column:
    return dot(l2_normalize(a), l2_normalize(b))
