"""SimHash fingerprints and their self-join on a binary trie.

Fingerprints are the leaves of a binary trie. The join walks pairs of nodes together: a pair's children are the pairs
of its nodes' children, a pair whose prefixes differ in more bits than the budget is dropped, and what reaches the
leaves is linked. The upper levels are dealt out over the cluster: with a budget of k bits and a trie cut into m blocks,
two linked fingerprints agree on m - k blocks, so for every choice of m - k blocks the trie is turned to have those
first, and a node below them is one unit of work. A node with too many fingerprints is opened further: its rows go to
the pairs of its children's children that can still be within the budget, until no unit is large. The unit is solved by
the same walk, on arrays.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafstack.llm._common import arrow_batches, pieces, written
from leafstack.llm.components import Forest, components

SEED = 42
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACE = (np.arange(8, dtype=np.int64) * 256)[None, :]


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """In how many of the 64-bit hashes each bit is set."""
    out = np.zeros((8, 256), np.int64)
    for i in range(0, len(hashes), 1 << 16):
        octets = hashes[i : i + (1 << 16)].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        out += np.bincount((octets + _PLACE).ravel(), minlength=2048).reshape(8, 256)
    return (out @ _BYTE_BITS).ravel()


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: a bit is 1 if it is set in over half the hashes; zero if there are none."""
    if not len(hashes):
        return 0
    return int(np.packbits(2 * bit_counts(hashes) > len(hashes), bitorder="little").view("<u8")[0])


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """XXH64 of every run of ``n`` words joined by a space; of the whole sequence if there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    digest, n = xxhash.xxh64_intdigest, min(n, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist())
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - n + 1)


def fingerprints(df: DataFrame, text: str = "text", n: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and fp long (the 64 bits, signed) of A-Z lower-cased words [^\\x20\\x09-\\x0D]+, shingles with repeats."""
    arrow_batches(df.sparkSession)
    df = df.select(*keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, text):
                fps = [majority(shingle_hashes(x.as_buffer().to_pybytes().lower().split(), n)) if x.is_valid else 0 for x in b.column(text)]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(np.array(fps, np.uint64).view(np.int64))], names=[*keep, "fp"])

    return df.mapInArrow(run, T.StructType([*(df.schema[k] for k in keep), T.StructField("fp", T.LongType())]))


# ---------------------------------------------------------------- the walk over node pairs of one unit

LEAF = 64
BLOCK = 300_000


def walk(values: np.ndarray, frontier: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs of ``values`` within ``budget`` differing bits, with the number of bits.

    ``frontier``: rows (a_lo, a_hi, b_lo, b_hi), ranges of ascending values; equal ranges mean a node with itself.
    """
    if not len(frontier):
        return
    stack = [(63, np.column_stack([frontier, np.zeros(len(frontier), np.int64)]))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        bit, pairs = stack.pop()
        if len(pairs) > BLOCK:
            stack += [(bit, pairs[i : i + BLOCK]) for i in range(0, len(pairs), BLOCK)]
            continue
        small = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= LEAF
        if bit < 0:
            small[:] = True
        if small.any():
            yield from _leaves(values, pairs[small], budget)
            pairs = pairs[~small]
        if not len(pairs):
            continue
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        count = ones[bit]
        a0, a2, b0, b2, d = pairs.T
        a1, b1 = a2 - (count[a2] - count[a0]), b2 - (count[b2] - count[b0])
        own = (a0 == b0) & (a2 == b2)
        out = [
            np.column_stack([a0, a1, b0, b1, d]),
            np.column_stack([a1, a2, b1, b2, d]),
            np.column_stack([a0, a1, b1, b2, d + 1]),
            np.column_stack([a1, a2, b0, b1, d + 1])[~own],
        ]
        pairs = np.concatenate(out)
        stack.append((bit - 1, pairs[(pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3]) & (pairs[:, 4] <= budget)]))


def _leaves(values: np.ndarray, pairs: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    sizes = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
    cuts = np.concatenate([[0], np.nonzero(np.diff(np.cumsum(sizes) // (4 * BLOCK)))[0] + 1, [len(pairs)]])
    for x, y in zip(cuts[:-1], cuts[1:]):
        a0, _, b0, b2, _ = pairs[x:y].T
        n = sizes[x:y]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = np.repeat(b2 - b0, n)
        i, j = np.repeat(a0, n) + within // width, np.repeat(b0, n) + within % width
        own = np.repeat((a0 == b0) & (pairs[x:y, 1] == b2), n)
        take = ~own | (i < j)
        i, j = i[take], j[take]
        bits = np.bitwise_count(values[i] ^ values[j]).astype(np.int64)
        near = bits <= budget
        yield i[near], j[near], bits[near]


# ---------------------------------------------------------------- dealing the trie out


def blocks_for(count: int, budget: int, bits: int = 64, want: int = 32) -> int:
    """Fewest blocks with which the blocks that stay intact have enough bits to keep units near ``want`` rows."""
    m = budget + 1
    while m < budget + 6 and count / 2.0 ** (bits * (m - budget) / m) > want:
        m += 1
    return m


def _masks(budget: int, m: int) -> list[int]:
    cuts = [round(64 * i / m) for i in range(m + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(blocks, m - budget)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def unit_rows(df: DataFrame, fp: str, budget: int, m: int, table: int = 0) -> DataFrame:
    """``df`` once for every turned trie, with unit long (its node), side int (0: with itself) and fp_key."""
    masks = _masks(budget, m)
    keys = [F.xxhash64(F.lit(table), F.lit(k), F.col(fp).bitwiseAND(F.lit(_signed(mask)))) for k, mask in enumerate(masks)]
    return df.withColumn("unit", F.explode(F.array(*keys))).withColumn("side", F.lit(0)).withColumn("fp_key", F.col(fp))


OPEN_BITS = 6


def _opened(rows: DataFrame, level: int, budget: int) -> DataFrame:
    """Rows of large units, dealt to the pairs of nodes ``OPEN_BITS`` levels further down that differ in few enough bits."""
    at = [(5 + 11 * (OPEN_BITS * level + i)) % 64 for i in range(OPEN_BITS)]
    place = sum((F.shiftrightunsigned(F.col("fp_key"), b).bitwiseAND(F.lit(1)) * F.lit(1 << i) for i, b in enumerate(at)), F.lit(0)).cast("int")
    flips = [sum(1 << i for i in c) for k in range(min(budget, OPEN_BITS) + 1) for c in combinations(range(OPEN_BITS), k)]
    rows = rows.withColumn("_p", place).withColumn("_q", F.explode(F.array(*map(F.lit, flips)))).withColumn("_q", F.col("_p").bitwiseXOR(F.col("_q")))
    # a row of a pair of different nodes keeps its side; a pair of sides splits into pairs that take one node of each
    a = F.when(F.col("side") == 2, F.col("_q")).otherwise(F.col("_p"))
    b = F.when(F.col("side") == 2, F.col("_p")).otherwise(F.col("_q"))
    lone = F.col("side") == 0
    low, high = F.when(lone, F.least(a, b)).otherwise(a), F.when(lone, F.greatest(a, b)).otherwise(b)
    side = F.when(lone & (low == high), F.lit(0)).when(lone, F.when(F.col("_p") == low, F.lit(1)).otherwise(F.lit(2))).otherwise(F.col("side"))
    return rows.withColumn("unit", F.xxhash64("unit", F.lit(level), low, high)).withColumn("side", side).drop("_p", "_q")


def _live(units: DataFrame) -> DataFrame:
    """unit, work double (pairs that a unit could compare) of the units that compare anything."""
    side = lambda k: F.sum((F.col("side") == k).cast("long"))
    sizes = units.groupBy("unit").agg(side(0).alias("n0"), side(1).alias("n1"), side(2).alias("n2"))
    return sizes.select("unit", (F.col("n0") * (F.col("n0") - 1) / 2 + F.col("n1") * F.col("n2")).alias("work")).where("work > 0")


def dealt(units: DataFrame, budget: int, largest: int = 2000) -> DataFrame:
    """Open units until none compares more pairs than ``largest`` rows with each other (or all bits are used up).

    Of an opened unit only pairs of nodes that both have rows are kept, so a dense group is cut into as many units as its
    work needs and its rows are not copied into pairs that compare nothing.
    """
    most, done, level = largest * (largest - 1) / 2, None, 0
    while OPEN_BITS * level < 64:
        large = written(_live(units).where(F.col("work") > most).select("unit"), "large_units")
        if large.isEmpty():
            break
        rest = units.join(large, "unit", "left_anti")
        opened = _opened(units.join(large, "unit", "left_semi"), level, budget)
        opened = written(opened.join(_live(opened).select("unit"), "unit", "left_semi"), "opened_units")
        done = rest if done is None else done.unionByName(rest)
        units = opened
        level += 1
    return units if done is None else done.unionByName(units)


def segments(batches: Iterable[pa.RecordBatch], rows: int = 200_000) -> Iterator[pa.Table]:
    """Whole units of a partition that is sorted by unit, gathered up to about ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    total = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        total += b.num_rows
        if total >= rows:
            t = pa.Table.from_batches(held)
            unit = t.column("unit").to_numpy()
            cut = int(np.searchsorted(unit != unit[-1], False)) if unit[0] == unit[-1] else int(np.nonzero(unit != unit[-1])[0][-1]) + 1
            if cut:
                yield t.slice(0, cut)
            held, total = t.slice(cut).to_batches(), t.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def unit_frontier(unit: np.ndarray, side: np.ndarray) -> np.ndarray:
    """One pair of ranges for each unit; rows are sorted by unit and side."""
    if not len(unit):
        return np.zeros((0, 4), np.int64)
    start = np.concatenate([[0], np.nonzero((unit[1:] != unit[:-1]) | (side[1:] != side[:-1]))[0] + 1])
    stop = np.concatenate([start[1:], [len(unit)]])
    kind = side[start]
    own = (kind == 0) & (stop - start > 1)
    first = np.nonzero((kind[:-1] == 1) & (kind[1:] == 2) & (unit[start[:-1]] == unit[start[1:]]))[0] if len(start) > 1 else np.zeros(0, np.int64)
    return np.concatenate([np.column_stack([start[own], stop[own]] * 2), np.column_stack([start[first], stop[first], start[first + 1], stop[first + 1]])])


def links(fps: DataFrame, budget: int = 2, ident: str = "rep", fp: str = "fp") -> DataFrame:
    """Pairs a long, b long of ``ident`` whose distinct fingerprints differ in at most ``budget`` bits; a pair can repeat.

    ``fps`` holds one row for each fingerprint. A unit gives only the links that its own rows do not connect already, so
    what is emitted stays in proportion to the rows and the connected components stay the same.
    """
    arrow_batches(fps.sparkSession)
    m = blocks_for(fps.count(), budget)
    units = dealt(unit_rows(fps.select(F.col(ident).alias("id"), fp), fp, budget, m), budget)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in segments(batches):
            unit, side = t.column("unit").to_numpy(), t.column("side").to_numpy()
            values, ids = t.column("fp_key").to_numpy().view(np.uint64), t.column("id").to_numpy()
            order = np.lexsort((values, side, unit))
            unit, side, values, ids = unit[order], side[order], values[order], ids[order]
            forest = Forest(len(values))
            for found in walk(values, unit_frontier(unit, side), budget):
                forest.add(*found)
            yield pa.RecordBatch.from_arrays([pa.array(ids[forest.i]), pa.array(ids[forest.j])], names=["a", "b"])

    return units.select("unit", "side", "fp_key", "id").repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "a long, b long")


def linked_classes(df: DataFrame, budget: int = 2, n: int = 3, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``ident`` long, fp long, component long: the smallest ``ident`` that links of fingerprints reach.

    One row for each row of ``df``. Null and blank texts have the fingerprint zero and link like any other; rows with a
    null ``ident`` get the component of their fingerprint (null if it has no other row) and connect nothing themselves;
    equal texts, and equal fingerprints, are one node of the join. An empty table gives an empty table.
    """
    fps = written(fingerprints(df, text, n, (ident,)), "fingerprints")
    reps = written(fps.where(F.col(ident).isNotNull()).groupBy("fp").agg(F.min(ident).alias("rep")), "reps")
    roots = components(links(reps, budget))
    classes = reps.join(roots, reps.rep == roots.node, "left").select("fp", F.coalesce("root", "rep").alias("component"))
    return fps.join(classes, "fp", "left").select(ident, "fp", "component")
