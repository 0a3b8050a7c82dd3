"""The best rows of each query: over a table, and of what one task sees."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best(scored: DataFrame, query: str, ident: str, k: int) -> DataFrame:
    """The ``k`` highest scores of each query; equal scores by ident."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.col("score").desc(), ident))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


class Best:
    """The ``k`` best (score, id) of each query so far; equal scores by id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, None, None

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores``: a row for each query, a column for each id."""
        ids = np.broadcast_to(ids, scores.shape)
        if scores.shape[1] > 4 * self.k:  # an id that reaches no query's k-th best score need not be sorted
            least = np.partition(scores, -self.k, axis=1)[:, -self.k]
            some = (scores >= least[:, None]).any(axis=0)
            scores, ids = scores[:, some], ids[:, some]
        if self.scores is not None:
            scores, ids = np.concatenate([self.scores, scores], axis=1), np.concatenate([self.ids, ids], axis=1)
        at = np.lexsort((ids, -scores), axis=1)[:, : self.k]
        self.scores, self.ids = np.take_along_axis(scores, at, 1), np.take_along_axis(ids, at, 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(self.ids)), self.ids.shape[1]), self.ids.ravel(), self.scores.ravel()
