"""Connected components of a link table that is never gathered anywhere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafstack.llm._common import drop_written, written


def components(links: DataFrame) -> DataFrame:
    """Columns node long, root long for every node of ``links`` (a long, b long): root is the smallest node it reaches.

    Alternates two star contractions until the links no longer change: every larger neighbour of a node is linked to the
    smallest neighbour, then every smaller neighbour is. Minima are partial aggregates, and the joins are plain equi-joins
    that adaptive execution can split, so a node with very many links is no single task's work. Each round is written to
    shared storage. Self links and nulls are ignored; an empty table gives an empty table.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large_star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        small = written(small, "small_star")
        now = _state(small)
        drop_written(edges, large)
        edges = small
        if now == state:
            break
        state = now
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def spanning(i: np.ndarray, j: np.ndarray, level: np.ndarray, n: int) -> np.ndarray:
    """Positions of pairs that connect what all pairs (i, j) of 0..n-1 connect, by ascending level (a minimum spanning forest)."""
    root, chosen = np.arange(n), [np.zeros(0, np.int64)]
    order = np.argsort(level, kind="stable")
    cuts = np.concatenate([[0], np.nonzero(np.diff(level[order]))[0] + 1, [len(order)]])
    for x, y in zip(cuts[:-1], cuts[1:]):
        at = order[x:y]
        while len(at):
            a, b = root[i[at]], root[j[at]]
            apart = a != b
            at, low, high = at[apart], np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            if not len(at):
                break
            o = np.lexsort((low, high))
            first = o[np.concatenate([[True], high[o][1:] != high[o][:-1]])]
            root[high[first]] = low[first]
            chosen.append(at[first])
            while not np.array_equal(up := root[root], root):
                root = up
    return np.concatenate(chosen)


class Forest:
    """Of pairs that arrive in blocks, a minimum spanning forest, one of the pairs outside it, and so on ``depth`` times."""

    def __init__(self, n: int, depth: int = 1):
        self.n, self.depth = n, depth
        self.i, self.j, self.level = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, i: np.ndarray, j: np.ndarray, level: np.ndarray) -> None:
        i, j, level = np.concatenate([self.i, i]), np.concatenate([self.j, j]), np.concatenate([self.level, level])
        left, chosen = np.arange(len(i)), []
        for _ in range(self.depth):
            at = spanning(i[left], j[left], level[left], self.n)
            chosen.append(left[at])
            left = np.delete(left, at)
        at = np.concatenate(chosen)
        self.i, self.j, self.level = i[at], j[at], level[at]
