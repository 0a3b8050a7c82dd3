"""Approximate nearest vectors: vectors are kept by the cell of their nearest centre, and a query looks into a few cells.

Centres come from a bounded sample; every vector is put into its cell. Stored partitioned by cell, a search reads the cells
that its queries look into and no others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafstack.operators.dense import QUERY_BLOCK, _unit
from leafstack.operators.sparse import best


#: Bytes of the sample that centres are made from, as doubles.
SAMPLE_BYTES = 256 << 20


def centres(vectors: DataFrame, ident: str, vector: str = "embedding", cells: int = 256, sample: int = 65_536, rounds: int = 10) -> np.ndarray:
    """Unit centres of at most ``cells`` cells, by spherical k-means of the ``sample`` vectors with the smallest hash of their id.

    The sample comes as Arrow arrays; wide vectors make it smaller, so that it has at most ``SAMPLE_BYTES``.
    """
    some = vectors.where(F.col(vector).isNotNull())
    width = some.select(F.size(vector).alias("n")).first()
    sample = min(sample, SAMPLE_BYTES // (8 * max(1, width.n if width else 1)))
    column = some.select(F.col(vector).cast("array<float>").alias("v"), F.xxhash64(ident).alias("h"), F.col(ident).alias("i")).orderBy("h", "i").limit(sample).select("v").toArrow().column("v").combine_chunks()
    points = _unit(column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)) if len(column) else np.zeros((0, 1))
    out = points[: min(cells, len(points))].copy()
    for _ in range(rounds if len(out) else 0):
        nearest = (points @ out.T).argmax(axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, nearest, points)
        filled = np.bincount(nearest, minlength=len(out)) > 0
        out[filled] = _unit(sums[filled])
    return out


def with_cells(vectors: DataFrame, centre: np.ndarray, vector: str = "embedding") -> DataFrame:
    """``vectors`` with cell int; rows without a vector have none and are left out."""
    schema = T.StructType([*(f for f in vectors.schema.fields if f.name != "cell"), T.StructField("cell", T.IntegerType())])
    kept = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rows = b.column(vector).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                cell = (_unit(rows) @ centre.T).argmax(axis=1) if len(centre) else np.zeros(b.num_rows)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(cell.astype(np.int32))], names=schema.names)

    return vectors.where(F.col(vector).isNotNull()).select(*kept).mapInArrow(run, schema)


def cells_topk(indexed: DataFrame, centre: np.ndarray, queries: DataFrame, ident: str, query: str, vector: str = "embedding", k: int = 40, probes: int = 16) -> DataFrame:
    """query, ident, score double (6 decimals), rank int: the ``k`` nearest among the ``probes`` cells nearest to each query.

    ``queries`` is a stated set, read by the driver in blocks, as in ``dense_topk``.
    """
    kind, found, held = dict(queries.dtypes)[query], [], []
    rows = queries.select(query, vector).toLocalIterator()
    while True:
        held = [(r[0], r[1]) for r, _ in zip(rows, range(QUERY_BLOCK))]
        if held or not found:
            found.append(_probed(indexed, centre, held, kind, ident, query, vector, k, probes))
        if len(held) < QUERY_BLOCK:
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return best(out, query, ident, k)


def _probed(indexed: DataFrame, centre: np.ndarray, held: list, kind: str, ident: str, query: str, vector: str, k: int, probes: int) -> DataFrame:
    names = np.array([q for q, _ in held])
    matrix = _unit(np.array([v for _, v in held], np.float64)) if held else np.zeros((0, centre.shape[1]))
    looked = np.argsort(-(matrix @ centre.T), axis=1, kind="stable")[:, :probes]
    by_cell = {c: np.nonzero((looked == c).any(axis=1))[0] for c in np.unique(looked).tolist()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = b.column("cell").to_numpy()
            for c in np.unique(cells).tolist():
                asked, at = by_cell.get(c, ()), np.nonzero(cells == c)[0]
                if not len(asked):
                    continue
                part = b.take(pa.array(at))
                rows = _unit(part.column(vector).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), -1))
                scores = np.round(rows @ matrix[asked].T, 6)
                order = np.argsort(np.argsort(np.array(part.column(ident).to_pylist()), kind="stable"), kind="stable")
                top = np.lexsort((np.broadcast_to(order[:, None], scores.shape).T, -scores.T), axis=1)[:, :k]
                q, r = np.repeat(np.arange(len(asked)), top.shape[1]), top.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(names[asked[q]]), part.column(ident).take(pa.array(r)), pa.array(scores[r, q])], names=[query, ident, "score"])

    schema = f"`{query}` {kind}, `{ident}` {dict(indexed.dtypes)[ident]}, score double"
    cells = [int(c) for c in by_cell]
    return indexed.where(F.col("cell").isin(*cells) if cells else F.lit(False)).select(ident, vector, "cell").mapInArrow(run, schema)
