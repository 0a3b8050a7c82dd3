"""Whitening of embeddings by a randomised range finder and Rayleigh-Ritz.

Entries become integers, so the sums that centre them are exact. The covariance V is never formed: a pass multiplies it into
a narrow block Q, as the sum of c (c Q) over all centred rows c, a partial sum a task. Random directions, a few more than
components are wanted, are multiplied a few times (power passes) and made orthonormal; Rayleigh-Ritz on their span gives the
components, and V Q, which is at hand, their residuals. While these are not at double precision the block is widened, in the
end to all dimensions, where the span is the whole space and the components are those of V whatever its spectrum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafstack.llm._common import arrow_batches

#: An entry c is counted as floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Entries this large are refused by ``fit``.
BEYOND = 1 << 62


@dataclass(frozen=True)
class Whitening:
    """``n`` rows with the sums ``sums`` were fitted; columns of ``vectors`` are unit components with the eigenvalues ``values``.

    ``passes``: how often the rows were multiplied; ``width``: how many directions it took.
    """

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    passes: int
    width: int

    @property
    def explained(self) -> np.ndarray:
        """The share of the variance that each component has."""
        return self.values / self.trace if len(self.values) else self.values

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n, rounded once."""
        return (self.n * x - self.sums) / self.n

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)


def integers(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a list array, the places of vectors with ``d`` finite entries, and their integers."""
    at = np.nonzero(pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False) == d)[0]
    values = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), d)  # null is NaN
    whole = np.isfinite(values).all(axis=1)
    return at[whole], np.clip(np.floor(SCALE * values[whole]), -BEYOND, BEYOND).astype(np.int64) + OFFSET


def _vectors(df: DataFrame, vector: str) -> DataFrame:
    return df.where(F.col(vector).isNotNull()).select(F.col(vector).alias("v"))


def _summed(rows: DataFrame, d: int, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int], kind: str) -> np.ndarray:
    """The sum of ``part(x)`` over the integers x of all whole vectors, a matrix of that shape: one partial sum a task, added up row by row in tasks.

    What reaches the driver is the matrix. Partial sums are added in the order of their tasks, so that it always is the same.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, kind)
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                total += part(integers(b.column("v").slice(i, 4096), d)[1])
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(range(shape[0]), pa.int32()), pa.array([task] * shape[0], pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["row", "task", "numbers"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for row, numbers in zip(b.column("row").to_pylist(), b.column("numbers")):
                sums[row] = sums.get(row, 0) + np.frombuffer(numbers.as_buffer(), kind)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["row", "numbers"])

    parts = rows.mapInArrow(partial, "row int, task int, numbers binary")
    found = parts.repartition("row").sortWithinPartitions("row", "task").mapInArrow(add, "row int, numbers binary").collect()
    out = np.zeros(shape, kind)
    for r in found:
        out[r.row] = np.frombuffer(r.numbers, kind)
    return out


def _dimension(rows: DataFrame) -> tuple[int, int]:
    """The commonest length of a whole vector (the smaller one of equally common ones), and how many rows have it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[int, int]] = {}
        for b in batches:
            for d in pc.unique(pc.list_value_length(b.column("v"))).to_pylist():
                x = integers(b.column("v"), d)[1] if d else None
                if x is not None and len(x):
                    n, most = seen.get(d, (0, 0))
                    seen[d] = n + len(x), max(most, int(np.abs(x).max()))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), *(pa.array([v[k] for v in seen.values()], pa.int64()) for k in (0, 1))], names=["d", "n", "most"])

    counts = rows.mapInArrow(count, "d int, n long, most long").groupBy("d").agg(F.sum("n").alias("n"), F.max("most").alias("most"))
    top = counts.agg(F.max(F.struct("n", (-F.col("d")).alias("d"), "most")).alias("t")).first().t
    if top is None:
        return 0, 0
    if top.n * top.most >= BEYOND:
        raise ValueError("entries are too large for exact sums of their deviations")
    return -top.d, top.n


def fit(df: DataFrame, vector: str = "embedding", components: int = 32, oversample: int = 8, power: int = 2, tolerance: float = 1e-13, seed: int = 42) -> Whitening:
    """The first ``components`` components of the rows of ``df``.

    Vectors of another length than the commonest one are left out, as are null ones and those with null or non-finite
    entries; repeated rows count as often as they occur. Components without variance cannot be scaled to one and are left
    out, so a table whose rows are all alike has none, and neither has an empty table. Of equal eigenvalues the components
    are some basis of their span.
    """
    arrow_batches(df.sparkSession)
    rows = _vectors(df, vector)
    d, n = _dimension(rows)
    if not d:
        return Whitening(0, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 0.0, 0, 0)
    sums = _summed(rows, d, lambda x: x.sum(axis=0)[None, :], (1, d), "<i8")[0]
    centre = Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0, 0, 0)

    def times(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = centre.centred(x)
            return c.T @ (c @ q)

        return _summed(rows, d, part, q.shape, "<f8") / n

    trace = float(_summed(rows, d, lambda x: np.array([[np.square(centre.centred(x)).sum()]]), (1, 1), "<f8")[0, 0]) / n
    draw = np.random.default_rng(seed)
    wanted, width, left, passes = min(components, d), min(d, components + oversample), power, 0
    q = np.linalg.qr(draw.standard_normal((d, width)))[0]
    while True:
        vq, passes = times(q), passes + 1
        h = q.T @ vq
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors = q @ turn
        residual = np.linalg.norm(vq @ turn - vectors * values, axis=0)[:wanted].max()
        if width == d or residual <= tolerance * max(values[0], 0.0):
            break
        if left:
            left, q = left - 1, np.linalg.qr(vq)[0]
        else:
            more = min(d, 2 * width) - width
            left, width = power, width + more
            q = np.linalg.qr(np.column_stack([vq, draw.standard_normal((d, more)) * np.linalg.norm(vq)]))[0]
    values, vectors = values[:wanted], vectors[:, :wanted]
    some = values > max(values[0], 0.0) * d * 1e-14
    values, vectors = values[some], vectors[:, some]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return Whitening(n, sums, vectors * sign, values, trace, passes, width)


def whitened(df: DataFrame, model: Whitening, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``ident``, deviation long, whitened array<double>: of every row that ``fit`` counts, also of other tables than the fitted one.

    deviation: the sum over the dimensions of (n x - sums)^2, exact; null where it does not fit a long.
    """
    d = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows if d else 0, 4096):
                b = whole.slice(i, 4096)
                at, x = integers(b.column("v"), d)
                out = model.project(x)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), out.shape[1]).cast(pa.list_(pa.float64())) if out.shape[1] else pa.array([[]] * len(at), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column("i").take(pa.array(at)), pa.array(_deviations(model.n * x - model.sums), pa.int64()), lists], names=[ident, "deviation", "whitened"])

    rows = df.where(F.col(vector).isNotNull()).select(F.col(ident).alias("i"), F.col(vector).alias("v"))
    return rows.mapInArrow(run, T.StructType([df.schema[ident], T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))]))


def _deviations(t: np.ndarray) -> list[int | None]:
    if float(np.abs(t).max(initial=0)) ** 2 * t.shape[1] < 9e18:
        return np.square(t).sum(axis=1).tolist()
    exact = (sum(v * v for v in row) for row in t.tolist())
    return [v if v < 1 << 63 else None for v in exact]


def identity_error(df: DataFrame, model: Whitening, vector: str = "embedding") -> float | None:
    """The largest absolute entry of the whitened rows' covariance minus the identity; None without components or rows."""
    k, d = len(model.values), len(model.sums)
    if not k:
        return None
    rows = _vectors(df, vector)

    def part(x: np.ndarray) -> np.ndarray:
        w = model.project(x)
        return np.vstack([w.T @ w, w.sum(axis=0), np.full(k, len(w))])

    total = _summed(rows, d, part, (k + 2, k), "<f8")
    if not total[k + 1, 0]:
        return None
    mean = total[k] / total[k + 1, 0]
    return float(np.abs(total[:k] / total[k + 1, 0] - np.outer(mean, mean) - np.eye(k)).max())


def whitening(df: DataFrame, ident: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """``ident``, component int from 1, n long, deviation long, whitened double, explained double, identity_error double.

    One row for each component of each row with a whole vector (see ``fit``), fitted on the same rows. Rows with a null
    ``ident`` are rows like others; other columns are not read.
    """
    model = fit(df, vector, components)
    error = identity_error(df, model, vector)
    rows = whitened(df, model, ident, vector).select(ident, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = F.array(*map(F.lit, model.explained.tolist())).cast("array<double>")
    return rows.select(ident, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
