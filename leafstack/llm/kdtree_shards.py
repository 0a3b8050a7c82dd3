"""Shards of near equal bytes from a k-d tree over document metadata.

A node that must hold k leaves is split where its bytes divide as k // 2 to k - k // 2, along its widest dimension
(range relative to the whole table's). The weighted quantile is found without sorting: rows of all nodes of a level are
summed into a fixed number of value ranges, and the range that holds the quantile is refined until its edge is close
enough. Rows that agree on the value are told apart by the checksum of their text and last by their id, so equal texts
stay together wherever the tolerance allows, and a value or text that holds a third of all rows is still cut.

Everything is DataFrame aggregation; the driver holds the tree (a few numbers a leaf) and, for one round of one level,
``FAN`` sums a node.

Defined results: null text counts no bytes and has the checksum of the empty text; a null id sorts first; repeated rows
get different slots; fewer rows than shards leave shards empty; an empty table gives an empty table; other columns are
not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafstack.llm._common import written

FAN = 1024


@dataclass
class Node:
    number: int
    leaves: int
    first: int
    dim: int = 0
    goal: float = 0.0
    below: int = 0
    part: int = 0
    lo: int = 0
    hi: int = 0
    fixed: list[int] = field(default_factory=list)
    cut: list[int] | None = None


def metadata(df: DataFrame, ident: str, text: str, dims: dict[str, Column] | None = None, extra: int = 16) -> DataFrame:
    """ident, size long, text_crc32 long, and the dimensions d0, d1, ... as longs."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    size = F.octet_length(t).cast("long")
    dims = dims or {
        "log_size": (F.log2(size + 1) * 1e6).cast("long"),
        "wide_share": F.coalesce(F.try_divide((size - F.char_length(t)) * F.lit(10**6), size), F.lit(0)).cast("long"),
        "space_share": F.coalesce(F.try_divide((size - F.octet_length(F.replace(t, F.lit(" "), F.lit("")))) * F.lit(10**6), size), F.lit(0)).cast("long"),
    }
    return df.select(
        F.col(ident).alias("ident"),
        (size + extra).alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        *(c.cast("long").alias(f"d{i}") for i, c in enumerate(dims.values())),
    )


def _values(spark, rows: list[tuple], names: str) -> DataFrame:
    """A table of the tree, ``names`` with their types: at most a row for each shard, so the broadcast is bounded by their number."""
    columns = [n.split() for n in names.split(", ")]
    listed = ", ".join(f"({', '.join(f'{v}L' if kind == 'long' else str(v) for v, (_, kind) in zip(r, columns))})" for r in rows)
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {listed} AS t({', '.join(n for n, _ in columns)})"))


def _along(n_dims: int) -> Column:
    return F.element_at(F.array(*(F.col(f"d{i}") for i in range(n_dims))), F.col("dim") + 1)


def _ident() -> Column:
    return F.coalesce(F.col("ident"), F.lit(-(1 << 62)))


def _descended(rows: DataFrame, n_dims: int, level: list[Node]) -> DataFrame:
    """``rows`` with the node below the one they are in; leaves stay. A level is one join, however many nodes it has."""
    cuts = [(n.number, n.dim, len(n.cut), *[*n.cut, 0, 0][:3]) for n in level if n.cut is not None]
    if not cuts:
        return rows
    table = _values(rows.sparkSession, cuts, "node int, dim int, depth int, c0 long, c1 long, c2 long")
    by_ident = (F.col("depth") > 2) & (F.col("text_crc32") == F.col("c1")) & (_ident() < F.col("c2"))
    by_text = (F.col("depth") > 1) & (_along(n_dims) == F.col("c0")) & ((F.col("text_crc32") < F.col("c1")) | by_ident)
    below = (_along(n_dims) < F.col("c0")) | by_text
    child = F.when(F.col("dim").isNull(), F.col("node")).when(below, 2 * F.col("node") + 1).otherwise(2 * F.col("node") + 2)
    return rows.join(table, "node", "left").withColumn("node", child.cast("int")).select(*rows.columns)


def build(meta: DataFrame, n_dims: int, shards: int, tolerance: float) -> tuple[DataFrame, dict[int, int]]:
    """``meta`` with the node of the finished tree, and the shard of each leaf node."""
    level, shard_of = [Node(0, shards, 0)], {}
    spans: list[int] | None = None
    # zero for every row, though not a constant, so that the root is joined like any node
    rows = meta.withColumn("node", F.least(F.col("size"), F.lit(0)).cast("int"))
    while level:
        for n in [n for n in level if n.leaves == 1]:
            shard_of[n.number] = n.first
        level = [n for n in level if n.leaves > 1]
        if not level:
            break
        ranges = [f(f"d{i}").alias(f"{name}{i}") for i in range(n_dims) for name, f in (("lo", F.min), ("hi", F.max))]
        found = {r.node: r for r in rows.groupBy("node").agg(F.sum("size").alias("bytes"), F.min("ident").alias("id_lo"), F.max("ident").alias("id_hi"), *ranges).collect()}
        if spans is None:
            spans = [max(1, found[0][f"hi{i}"] - found[0][f"lo{i}"]) if found else 1 for i in range(n_dims)]
            leaf = found[0].bytes / shards if found else 0
        for n in level:
            if (r := found.get(n.number)) is None:
                continue
            n.dim = max(range(n_dims), key=lambda i: (r[f"hi{i}"] - r[f"lo{i}"]) / spans[i])
            n.goal = r.bytes * (n.leaves // 2) / n.leaves
            n.lo, n.hi = r[f"lo{n.dim}"], r[f"hi{n.dim}"]
        ids = {n.number: (r.id_lo, r.id_hi) for n in level if (r := found.get(n.number))}
        _find_cuts(rows, n_dims, [n for n in level if n.number in ids], ids, leaf * tolerance)
        rows = _descended(rows, n_dims, level)
        level = [Node(2 * n.number + 1 + s, k, n.first + s * (n.leaves // 2)) for n in level for s, k in ((0, n.leaves // 2), (1, n.leaves - n.leaves // 2))]
    return rows, shard_of


def _find_cuts(rows: DataFrame, n_dims: int, nodes: list[Node], ids: dict[int, tuple], tolerance: float) -> None:
    along = _along(n_dims)
    value = F.when(F.col("part") == 0, along).when(F.col("part") == 1, F.col("text_crc32")).otherwise(_ident())
    inside = ((F.col("part") < 1) | (along == F.col("f0"))) & ((F.col("part") < 2) | (F.col("text_crc32") == F.col("f1")))
    while nodes:
        # one row of parameters for each node of the level that is still open: at most as many as there are shards
        params = [(n.number, n.dim, n.part, n.lo, n.hi, -(-(n.hi - n.lo + 1) // FAN), *[*n.fixed, 0, 0][:2]) for n in nodes]
        table = _values(rows.sparkSession, params, "node int, dim int, part int, lo long, hi long, width long, f0 long, f1 long")
        sums = (
            rows.join(table, "node")
            .withColumn("value", value)
            .where(inside & F.col("value").between(F.col("lo"), F.col("hi")))
            .groupBy("node", F.floor((F.col("value") - F.col("lo")) / F.col("width")).cast("long").alias("at"))
            .agg(F.sum("size").alias("bytes"), F.min("value").alias("lo"), F.max("value").alias("hi"))
            .collect()
        )
        by_node: dict[int, list] = {}
        for r in sorted(sums, key=lambda r: r.at):
            by_node.setdefault(r.node, []).append(r)
        open_nodes = []
        for n in nodes:
            at = n.below
            for bucket in by_node.get(n.number, []):
                if at + bucket.bytes >= n.goal:
                    break
                at += bucket.bytes
            tail = [bucket.hi + 1] if bucket.hi < (1 << 62) else [bucket.hi]
            after = at + bucket.bytes
            if n.goal - at <= tolerance and n.goal - at <= after - n.goal:
                n.cut = [*n.fixed, bucket.lo]
            elif after - n.goal <= tolerance:
                n.cut = [*n.fixed, *tail]
            elif bucket.lo < bucket.hi:
                n.below, n.lo, n.hi = at, bucket.lo, bucket.hi
                open_nodes.append(n)
            elif n.part < 2:
                n.below, n.part = at, n.part + 1
                n.fixed = [*n.fixed, bucket.lo]
                low, high = ids[n.number]
                n.lo, n.hi = (0, (1 << 32) - 1) if n.part == 1 else (-(1 << 62) if low is None else low, -(1 << 62) if high is None else high)
                open_nodes.append(n)
            else:  # rows that share even their id stay together on the nearer side
                n.cut = [*n.fixed, bucket.lo] if n.goal - at <= after - n.goal else [*n.fixed, *tail]
        nodes = open_nodes


def shards(df: DataFrame, count: int = 40, ident: str = "doc_id", text: str = "text", dims: dict[str, Column] | None = None, tolerance: float = 0.002, slot_rows: int = 20_000) -> DataFrame:
    """Columns ident, size long, text_crc32 long, shard int, slot long; ``tolerance``: of a shard's bytes, for each cut.

    Slots are row numbers inside parts of a shard, shifted by the rows of the shard's earlier parts, so no shard is
    sorted by one task.
    """
    meta = written(metadata(df, ident, text, dims), "metadata")
    n_dims = sum(c.startswith("d") for c in meta.columns)
    tree, shard_of = build(meta, n_dims, count, tolerance)
    leaves = _values(df.sparkSession, sorted(shard_of.items()), "node int, shard int")
    parts = max(4, meta.count() // (count * slot_rows) + 1)
    rows = tree.join(leaves, "node").withColumn("part", F.pmod(F.xxhash64("ident", "text_crc32"), F.lit(parts)))
    sizes = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    start = sizes.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("start"))
    numbered = rows.withColumn("k", F.row_number().over(Window.partitionBy("shard", "part").orderBy("ident", "text_crc32")))
    placed = numbered.join(F.broadcast(start) if parts * count <= 10_000 else start, ["shard", "part"])
    return placed.select(F.col("ident").alias(ident), "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("start") + F.col("k") - 1).alias("slot"))
