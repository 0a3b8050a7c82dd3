"""Near-duplicate classes: SimHash trie joins link most of a class, a shingle prefix filter meets every other pair.

Words lose their case and the marks at their ends. A document has ``tables`` independent 64-bit fingerprints over its
distinct words, whose bits hardly move under the edits that keep five-word shingles alike. The trie join of ``simhash``
links fingerprints that differ in at most ``budget`` bits; those links, and the documents that share a fingerprint, are
proposals. The exact Jaccard similarity of five-word shingle sets decides them: at ``similarity`` or above they are linked.

That finds most links cheaply but not all, so a second search is exact. All shingles have one order, those that are common
in the whole table last. Two sets at ``similarity`` or above share a shingle among the first n - ceil(similarity n) + 1 of
either, n its size; documents meet at each of those. All that meet are compared, but for pairs that sizes or places in the
order rule out and pairs that links of the first search have already joined. Classes are the connected components of all
links. So the first search, whatever it proposes, only saves work: no pair at the similarity is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafstack.llm import simhash
from leafstack.llm._common import KEY, arrow_batches, drop_written, inside, one_of_repeated, outside, pieces, release_memory, row_key, text_or_empty, written
from leafstack.llm._units import Units, hashes, mixed, words
from leafstack.llm.components import components

_SEEDS = [xxhash.xxh64_intdigest(str(i), simhash.SEED) for i in range(64)]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Texts as sequences of 64-bit word hashes, joined, and their bounds."""
    units = Units.of(texts)
    names = words(units.dictionary)
    bearing = pc.greater(pc.binary_length(names), 0).to_numpy(zero_copy_only=False)
    keep = bearing[units.codes]
    return hashes(names, simhash.SEED)[units.codes[keep]], np.concatenate([[0], np.cumsum(keep)])[units.bounds]


def _runs(flat: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(max(len(flat) - n + 1, 0), np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + flat[k : len(flat) - n + 1 + k]
    return mixed(out, n)


def shingle_sets(flat: np.ndarray, bounds: np.ndarray, n: int) -> list[np.ndarray]:
    """Of each text the distinct hashes of runs of ``n`` words, ascending; of the whole sequence if it is shorter."""
    runs, ends = _runs(flat, n), bounds.tolist()
    return [np.unique(runs[x : y - n + 1]) if y - x >= n else _runs(flat[x:y], y - x) if y > x else flat[:0] for x, y in zip(ends, ends[1:])]


#: Shingles are counted in so many places of a table by their hash; so its size is fixed, and many rare ones share a place.
PLACES = 1 << 20
_SLICE = 1 << 12


def _sketches(df: DataFrame, ident: str, text: str, n: int, tables: int) -> tuple[DataFrame, np.ndarray]:
    """One row for each row of ``df``, and how common the shingles of each place are (a byte).

    Columns: id, key long (of id and text), node long (a hash of the text), k1, k2 long (of the word sequence), f0, ...
    """
    longs = ["id", "key", "node", "k1", "k2", *(f"f{t}" for t in range(tables))]
    fields = [*(T.StructField(c, T.LongType()) for c in longs), T.StructField("slice", T.IntegerType()), T.StructField("counts", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(PLACES, np.int64)
        for batch in batches:
            for b in pieces(batch, "text"):
                flat, bounds = word_hashes(b.column("text"))
                fps, keys = np.zeros((tables, b.num_rows), np.uint64), np.zeros((2, b.num_rows), np.uint64)
                for i, (x, y) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
                    keys[:, i] = np.frombuffer(xxhash.xxh3_128_digest(flat[x:y].tobytes()), np.uint64)
                    own = np.unique(flat[x:y])
                    for t in range(tables):
                        fps[t, i] = simhash.majority(mixed(own, _SEEDS[t]))
                for s in shingle_sets(flat, bounds, n):
                    np.add.at(counts, _place(s), 1)
                nothing = [pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in longs[:3]), *(pa.array(c.view(np.int64)) for c in (*keys, *fps)), *nothing], names=[f.name for f in fields])
        slices = [i for i in range(0, PLACES, _SLICE) if counts[i : i + _SLICE].any()]
        # in the smallest numbers that hold them: one row of bytes for each slice
        kinds = [np.min_scalar_type(int(counts[i : i + _SLICE].max())) for i in slices]
        parts = [pa.array([i // _SLICE for i in slices], pa.int32()), pa.array([counts[i : i + _SLICE].astype(k).tobytes() for i, k in zip(slices, kinds)], pa.binary())]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(slices), pa.int64()) for _ in longs), *parts], names=[f.name for f in fields])
        release_memory()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column("slice").to_pylist(), batch.column("counts")):
                numbers = np.frombuffer(c.as_buffer(), f"<u{len(c.as_buffer()) // _SLICE}")
                sums[k] = sums.get(k, 0) + numbers.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([c.tobytes() for c in sums.values()], pa.binary())], names=["slice", "counts"])

    texts = df.select(F.col(ident).cast("long").alias("id"), text_or_empty(text).alias("text"))
    rows = written(texts.select("id", row_key("id", "text").alias("key"), F.xxhash64("text").alias("node"), "text").mapInArrow(run, T.StructType(fields)), "sketches")
    common = np.zeros(PLACES, np.int64)
    counted = rows.where("slice IS NOT NULL").select("slice", "counts").repartition("slice").mapInArrow(total, "slice int, counts binary")
    for r in counted.collect():  # PLACES numbers in all
        common[r.slice * _SLICE : (r.slice + 1) * _SLICE] += np.frombuffer(r.counts, np.int64)
    return rows.where("slice IS NULL").select(*longs), (4 * np.log2(common + 1)).astype(np.uint8)


def _place(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - PLACES.bit_length() + 1)).astype(np.int64)


def _proposed(nodes: DataFrame, tables: int, budget: int) -> DataFrame:
    """Pairs a < b of ``node``: the links of each table's trie join, and each node with the least of its fingerprint.

    A unit of the trie join gives at most as many links as it has rows, so proposals stay in proportion to the documents.
    """
    found = []
    for t in range(tables):
        fps = written(nodes.groupBy(F.col(f"f{t}").alias("fp")).agg(F.min("node").alias("rep")), "fingerprints")
        shared = nodes.select(F.col("node").alias("a"), F.col(f"f{t}").alias("fp")).join(fps, "fp").select("a", F.col("rep").alias("b"))
        found += [simhash.links(fps, budget), shared]
    pairs = reduce(DataFrame.unionByName, found).where("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def shingle_prefix(shingles: np.ndarray, similarity: float, common: np.ndarray) -> np.ndarray:
    """The shingles by which a set is met: its first ones, by how common they are and then by hash."""
    size = len(shingles)
    return shingles[np.argsort(common[_place(shingles)], kind="stable")][: size - ceil(similarity * size - 1e-9) + 1]


def _commonest(unit: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Whether a row has the root that its unit has most often (one of them)."""
    order = np.lexsort((roots, unit))
    u, r = unit[order], roots[order]
    new = np.concatenate([[True], (u[1:] != u[:-1]) | (r[1:] != r[:-1])])
    run, first = np.cumsum(new) - 1, np.nonzero(new)[0]
    counts = np.bincount(run)
    by_unit = np.lexsort((counts, u[first]))
    last = np.concatenate([u[first][by_unit][1:] != u[first][by_unit][:-1], [True]])
    chief = np.zeros(len(counts), bool)
    chief[by_unit[last]] = True
    out = np.zeros(len(unit), bool)
    out[order] = chief[run]
    return out


class Meeting:
    """Rows of one unit or more, and which of them can be similar and are not joined.

    ``tail``: how many of a set's ``size`` shingles stand at the unit's place in the order or after it. Sets share no more
    than that from the first place where they meet, so a row can only meet rows up to a size, and with rows by size those
    are a range. Rows of one root (``hub``, or the one that a unit has most often) are not paired with each other, so a
    large class costs no square. Without ``others`` only pairs with a row of that root are made.
    """

    def __init__(self, rows: dict[str, np.ndarray], similarity: float, hub: int | None = None, others: bool = True):
        unit, root, size = rows["unit"], rows["root"], rows["size"]
        joined = _commonest(unit, root) if hub is None else root == hub
        self.order = order = np.lexsort((size, joined, unit))
        self.rows, self.similarity = {k: v[order] for k, v in rows.items()}, similarity
        unit, size, joined = unit[order], size[order], joined[order]
        self.unit_no = np.cumsum(np.concatenate([[0], unit[1:] != unit[:-1]]))
        segment = 2 * self.unit_no + joined
        key = segment << 32 | size
        self.other = at = np.nonzero(~joined)[0]
        # no larger set than this can be similar to a row's
        most = np.clip(np.floor(self.rows["tail"][at] * (1 + similarity) / similarity - size[at] + 1e-6), 0, (1 << 32) - 1).astype(np.int64)
        least = np.ceil(similarity * size[at] - 1e-6).astype(np.int64)
        self.ranges = [(np.searchsorted(key, segment[at] + 1 << 32 | least), np.searchsorted(key, segment[at] + 1 << 32 | most, "right"))]
        if others:
            self.ranges.append((at + 1, np.searchsorted(key, segment[at] << 32 | most, "right")))
        self.ranges = [(start, np.maximum(start, stop)) for start, stop in self.ranges]

    def crowded(self, a_row: int, least: int) -> np.ndarray:
        """Units whose pairs are more than ``a_row`` times their rows, and more than ``least``; their pairs are taken out."""
        pairs = np.bincount(self.unit_no[self.other], weights=sum(stop - start for start, stop in self.ranges), minlength=self.unit_no[-1] + 1)
        full = pairs > np.maximum(a_row * np.bincount(self.unit_no), least)
        self.ranges = [(start, np.where(full[self.unit_no[self.other]], start, stop)) for start, stop in self.ranges]
        return self.rows["unit"][np.searchsorted(self.unit_no, np.nonzero(full)[0])]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (in sorted order) of two rows each."""
        rows, s = self.rows, self.similarity
        size, tail, root, node = rows["size"], rows["tail"], rows["root"], rows["node"]
        for start, stop in self.ranges:
            n = stop - start
            place = np.concatenate([[0], np.cumsum(n)])
            x = 0
            while x < len(n):
                y = max(x + 1, int(np.searchsorted(place, place[x] + (1 << 18), "right")) - 1)
                i = np.repeat(self.other[x:y], n[x:y])
                j = np.repeat(start[x:y] - place[x:y] + place[x], n[x:y]) + np.arange(len(i))
                shared = s / (1 + s) * (size[i] + size[j]) - 1e-6
                take = (root[i] != root[j]) & (node[i] != node[j]) & (np.minimum(tail[i], tail[j]) >= shared)
                yield i[take], j[take]
                x = y


def sketch_bits(size: np.ndarray | int) -> np.ndarray:
    """Bits of the sketch of a set: the power of two from four times its size on, and 64 at least."""
    return np.maximum(64, 1 << np.ceil(np.log2(np.maximum(4 * np.asarray(size), 1))).astype(np.int64))


def parity_sketch(shingles: np.ndarray) -> bytes:
    """Bit p: whether the number of shingles with p as their low bits is odd."""
    bits = int(sketch_bits(len(shingles)))
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Sketches:
    """Parity sketches of sets: where two differ, the sets do, so too many differing bits rule a pair out for certain."""

    def __init__(self, size: np.ndarray, flat: np.ndarray):
        self.words = sketch_bits(size) >> 6
        self.start, self.flat = np.concatenate([[0], np.cumsum(self.words)])[:-1], flat
        self.size, self.at_width = size, {}

    def _of(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Place of each row in a matrix of the sketches that have ``width`` words or fold to it."""
        if width not in self.at_width:
            own, twice = np.nonzero(self.words == width)[0], np.nonzero(self.words == 2 * width)[0]
            wide = self.flat[self.start[twice][:, None] + np.arange(2 * width)]
            place = np.full(len(self.words), -1)
            place[own], place[twice] = np.arange(len(own)), len(own) + np.arange(len(twice))
            self.at_width[width] = place, np.concatenate([self.flat[self.start[own][:, None] + np.arange(width)], wide[:, :width] ^ wide[:, width:]])
        return self.at_width[width]

    def near(self, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
        """Whether the sets can be as similar as that."""
        out = np.zeros(len(i), bool)
        narrow, wide = np.minimum(self.words[i], self.words[j]), np.maximum(self.words[i], self.words[j])
        out[wide > 2 * narrow] = True  # cannot happen at a similarity over a half
        for width in np.unique(narrow).tolist():
            at = np.nonzero((narrow == width) & (wide <= 2 * width))[0]
            place, sketches = self._of(width)
            for x in range(0, len(at), max(1, (1 << 20) // width)):
                k = at[x : x + max(1, (1 << 20) // width)]
                bits = np.bitwise_count(sketches[place[i[k]]] ^ sketches[place[j[k]]]).sum(axis=1, dtype=np.int64)
                out[k] = bits <= (1 - similarity) / (1 + similarity) * (self.size[i[k]] + self.size[j[k]]) + 1e-6
        return out


#: Columns of the places where sets are met, as they are sent, one column after the other. The first half of a shingle's
#: bits, beside its bucket, is all that is sent of it; where two shingles clash, pairs are looked at in vain. ``before``: the
#: shingle that stands before the unit in the set's order.
_SENT = (("unit", "<u4"), ("node", "<i8"), ("apart", "<i8"), ("size", "<u4"), ("tail", "<u4"))
_SENT_CLOSE = (*_SENT, ("before", "<u8"))


def _sent(columns: list[np.ndarray], kinds: tuple, x: int, y: int) -> bytes:
    return b"".join(c[x:y].astype(kind).tobytes() for c, (_, kind) in zip(columns, kinds))


def _received(rows: list[tuple[int, bytes]], kinds: tuple) -> tuple[dict[str, np.ndarray], list[memoryview]]:
    """The columns of several blobs (number of rows, bytes), joined; and what follows them in each blob."""
    out: dict[str, list[np.ndarray]] = {name: [] for name, _ in kinds}
    rest = []
    for n, blob in rows:
        at = 0
        for name, kind in kinds:
            out[name].append(np.frombuffer(blob, kind, n, at))
            at += out[name][-1].nbytes
        rest.append(memoryview(blob)[at:])
    columns = {name: np.concatenate(out[name]).astype(np.uint64 if name == "before" else np.int64) for name, kind in kinds}
    columns["root"] = columns["node"] ^ columns.pop("apart")
    return columns, rest


def _prefixes(df: DataFrame, nodes: DataFrame, common: np.ndarray, text: str, n: int, similarity: float, dense: int) -> DataFrame:
    """Of each node its root, size, prefix, sketch, and whether its class has over ``dense`` members."""
    levels = df.sparkSession.sparkContext.broadcast(common)  # PLACES bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for b in pieces(_first_seen(batch, "node", seen), "text"):
                sets = shingle_sets(*word_hashes(b.column("text")), n)
                heads = [shingle_prefix(s, similarity, levels.value).tobytes() if len(s) else b"" for s in sets]
                columns = [b.column("node"), pa.array([len(s) for s in sets], pa.int64()), pa.array(heads, pa.binary()), pa.array([parity_sketch(s) for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "size", "head", "sketch"])
        release_memory()

    texts = df.select(text_or_empty(text).alias("text")).select(F.xxhash64("text").alias("node"), "text")
    large = nodes.groupBy("root").agg(F.count("*").alias("members")).where(F.col("members") > dense).select("root", F.lit(True).alias("big"))
    known = nodes.join(large, "root", "left").select("node", "root", F.coalesce("big", F.lit(False)).alias("big"))
    heads = texts.mapInArrow(run, "node long, size long, head binary, sketch binary").where("size > 0").join(known, "node").dropDuplicates(["node"])
    return written(heads, "prefixes")


def _first_seen(batch: pa.RecordBatch, column: str, seen: set[int]) -> pa.RecordBatch:
    """The rows of a batch whose value this task has not seen yet."""
    return batch.filter(pa.array([x not in seen and not seen.add(x) for x in batch.column(column).to_pylist()], pa.bool_()))


def _dealt(heads: DataFrame, buckets: int, chunk: int, crowded: bytes | None) -> DataFrame:
    """Places where sets are met, as rows (unit, hub, chunk, n, rows) of whole buckets of shingles.

    A class that fills its bucket is dealt to chunks; what else is in the bucket is sent to each chunk. With ``crowded``, a
    bitmap of shingles, only those are sent, and with them the shingle before and the sketch.
    """
    kinds = _SENT if crowded is None else _SENT_CLOSE
    bitmap = None if crowded is None else heads.sparkSession.sparkContext.broadcast(crowded)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            for b in pieces(batch, "head", 2 << 20):
                lengths = pc.binary_length(b.column("head")).to_numpy(zero_copy_only=False).astype(np.int64) // 8
                row = np.repeat(np.arange(b.num_rows), lengths)
                unit = np.frombuffer(b"".join(b.column("head").to_pylist()), np.uint64)
                node, root, size, big = (b.column(c).to_numpy(zero_copy_only=False)[row] for c in ("node", "root", "size", "big"))
                at = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                before = np.where(at > 0, np.concatenate([unit[:1], unit[:-1]]), np.uint64(0))
                bucket, group = (unit % np.uint64(buckets)).astype(np.int64), np.where(big, root, 0)
                order = np.lexsort((group, big, bucket))
                if marked is not None:
                    place = (unit[order] >> np.uint64(64 - CROWDED_BITS)).astype(np.int64)
                    order = order[(marked[place >> 3] >> (place & 7) & 1).astype(bool)]
                row, bucket, group, big = row[order], bucket[order], group[order], big[order]
                columns = [c[order] for c in (unit >> np.uint64(32), node, root ^ node, size, size - at, before)]
                edge = np.nonzero((bucket[1:] != bucket[:-1]) | (group[1:] != group[:-1]) | (big[1:] != big[:-1]))[0] + 1
                starts = np.concatenate([[0], edge])[: len(order)].astype(np.int64)
                ends = [*starts[1:].tolist(), len(order)]
                sketches = b.column("sketch").to_pylist() if marked is not None else []
                blobs = [_sent(columns, kinds, x, y) + (b"".join([sketches[r] for r in row[x:y].tolist()]) if sketches else b"") for x, y in zip(starts.tolist(), ends)]
                n = pa.array(np.diff([*starts.tolist(), len(order)]), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array(group[starts], mask=~big[starts]), n, pa.array(blobs, pa.binary())], names=["bucket", "root", "n", "rows"])
        release_memory()

    columns = ["node", "root", "size", "big", "head"] + ["sketch"] * (crowded is not None)
    blobs = heads.select(*columns).mapInArrow(spread, "bucket long, root long, n long, rows binary")
    if heads.where("big").isEmpty():
        return blobs.select(F.col("bucket").alias("unit"), F.lit(None).cast("long").alias("hub"), F.lit(0).alias("chunk"), "n", "rows")
    blobs = written(blobs, "blobs")
    filled = blobs.where("root IS NOT NULL").groupBy("bucket", "root").agg(F.sum(F.octet_length("rows")).alias("bytes")).where(F.col("bytes") > chunk)
    fullest = filled.groupBy("bucket").agg(F.max("bytes").alias("bytes"), F.max_by("root", "bytes").alias("hub"))
    placed = blobs.join(written(fullest.select("bucket", "hub", F.ceil(F.col("bytes") / chunk).cast("int").alias("chunks")), "fullest"), "bucket", "left")
    own = F.array(F.pmod(F.xxhash64("rows"), F.col("chunks")).cast("int"))
    at = F.when(F.col("hub").isNull(), F.array(F.lit(0))).when(F.col("root").eqNullSafe(F.col("hub")), own).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    return placed.select("bucket", "hub", F.explode(at).alias("chunk"), "n", "rows").select(F.xxhash64("bucket", "chunk").alias("unit"), "hub", "chunk", "n", "rows")


#: Bits of the map of crowded shingles that is broadcast, as a power of two; when it fills up, more is looked at closely.
CROWDED_BITS = 24
#: A shingle is crowded if its rows make more than so many pairs a row, and so many pairs in all.
CROWDED = (8, 256)


def _meeting(heads: DataFrame, text_bytes: int, similarity: float, chunk: int) -> DataFrame:
    """Pairs a, b of nodes with different roots: all that can reach ``similarity``, and few others.

    Where a shingle brings many rows together, its pairs are not given out at once: its rows are sent again with their
    sketches, which rule most pairs out on the spot, and a pair that has met at the shingle before is left to that one.
    """
    buckets = 2048  # a fifth of the shingles are sent, and a word has about six bytes
    while text_bytes // 30 > 200_000 * buckets:
        buckets *= 2

    def parts(batches: Iterator[pa.RecordBatch], kinds: tuple) -> Iterator[tuple[Meeting, list[memoryview]]]:
        for t in simhash.segments(batches, 1):
            key = t.column("unit").to_numpy()
            edges = [0, *(np.nonzero(key[1:] != key[:-1])[0] + 1).tolist(), len(key)]
            for x, y in zip(edges, edges[1:]):
                part = t.slice(x, y - x)
                rows, rest = _received(list(zip(part.column("n").to_pylist(), part.column("rows").to_pylist())), kinds)
                yield Meeting(rows, similarity, part.column("hub")[0].as_py(), part.column("chunk")[0].as_py() == 0), rest

    def out(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, crowded: np.ndarray) -> pa.RecordBatch:
        a, b = rows["node"][i], rows["node"][j]
        both = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0)
        k, n = len(crowded), len(both)
        ids = [pa.concat_arrays([pa.array(both[:, c]), pa.nulls(k, pa.int64())]) for c in (0, 1)]
        return pa.RecordBatch.from_arrays([*ids, pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(crowded)])], names=["a", "b", "crowded"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m, _ in parts(batches, _SENT):
            yield out(m.rows, m.other[:0], m.other[:0], m.crowded(*CROWDED))
            for i, j in m.pairs():
                yield out(m.rows, i, j, m.rows["unit"][:0])
        release_memory()

    def meet_closely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m, rest in parts(batches, _SENT_CLOSE):
            before, size = m.rows["before"], np.zeros_like(m.rows["size"])
            size[m.order] = m.rows["size"]
            sketches, place = Sketches(size, np.frombuffer(b"".join(rest), "<u8")), m.order
            for i, j in m.pairs():
                new = (before[i] != before[j]) | (before[i] == 0)
                i, j = i[new], j[new]
                near = sketches.near(place[i], place[j], similarity)
                yield out(m.rows, i[near], j[near], m.rows["unit"][:0])
        release_memory()

    met = _dealt(heads, buckets, chunk, None).repartition("unit").sortWithinPartitions("unit").mapInArrow(meet, "a long, b long, crowded long")
    met = written(met.distinct(), "met")
    pairs = met.where("crowded IS NULL").select("a", "b")
    places = F.shiftright("crowded", 32 - CROWDED_BITS)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
    crowded = met.where("crowded IS NOT NULL").select(places.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    if not len(crowded):
        return pairs
    bitmap = np.zeros(1 << CROWDED_BITS - 6, "<i8")  # as many words at most reach the driver
    bitmap[crowded.column("word").to_numpy()] = crowded.column("bits").to_numpy()
    closer = _dealt(heads, buckets, chunk, bitmap.tobytes()).repartition("unit").sortWithinPartitions("unit").mapInArrow(meet_closely, "a long, b long, crowded long")
    return written(pairs.unionByName(closer.select("a", "b")).distinct(), "meeting")


def _plausible(pairs: DataFrame, heads: DataFrame, similarity: float) -> DataFrame:
    """The pairs that sizes and sketches do not rule out, so that few whole sets have to be sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.concatenate([b.column(c).to_numpy() for c in ("na", "nb")])
            sketches = Sketches(size, np.frombuffer(b"".join(x.as_buffer().to_pybytes() for c in ("sa", "sb") for x in b.column(c)), "<u8"))
            i = np.arange(b.num_rows)
            near = sketches.near(i, b.num_rows + i, similarity)
            small, large = np.sort(size.reshape(2, -1), axis=0)
            yield b.select(["a", "b"]).filter(pa.array(near & (small >= similarity * large - 1e-6)))

    one, two = (heads.select(F.col("node").alias(k), F.col("size").alias(f"n{k}"), F.col("sketch").alias(f"s{k}")) for k in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _similar(df: DataFrame, pairs: DataFrame, text: str, n: int, similarity: float) -> DataFrame:
    """The pairs of nodes whose shingle sets have a Jaccard similarity of at least ``similarity``."""
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted")
    texts = inside(df.select(text_or_empty(text).alias("text")).select(F.xxhash64("text").alias("node"), "text"), wanted, "node")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for b in pieces(_first_seen(batch, "node", seen), "text"):
                sets = [s.tobytes() for s in shingle_sets(*word_hashes(b.column("text")), n)]
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.binary())], names=["id", "s"])
        release_memory()

    sets = written(texts.mapInArrow(shingle, "id long, s binary").dropDuplicates(["id"]), "shingles")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("sa"), b.column("sb")):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True)) if min(len(u), len(v)) >= similarity * max(len(u), len(v)) else 0
                keep.append(0 < both >= similarity * (len(u) + len(v) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, two = (sets.select(F.col("id").alias(k), F.col("s").alias(f"s{k}")) for k in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(judge, "a long, b long")


def _classified(df: DataFrame, ident: str, text: str, n: int, similarity: float, tables: int, budget: int, dense: int, chunk: int) -> DataFrame:
    """One row for each row of ``df``: id, key, class_id, stays boolean (the row that stands for its class, or has none)."""
    arrow_batches(df.sparkSession)
    sketches, common = _sketches(df, ident, text, n, tables)
    first = [F.first(f"f{t}").alias(f"f{t}") for t in range(tables)]
    named = sketches.where("id IS NOT NULL").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.min_by("node", "id").alias("node"), *first)
    reps = written(named, "reps")
    pairs = written(_proposed(reps, tables, budget), "pairs")
    links = written(_similar(df, pairs, text, n, similarity), "similar")
    roots = components(links)
    nodes = written(reps.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "nodes")
    heads = _prefixes(df, nodes, common, text, n, similarity, dense)
    more = _meeting(heads, df.agg(F.sum(F.octet_length(text_or_empty(text)))).first()[0] or 0, similarity, chunk)
    joined = nodes.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    left = written(_plausible(more, heads, similarity), "plausible")
    roots = components(joined.unionByName(_similar(df, left, text, n, similarity)))
    members = written(reps.join(roots, "node", "left").select("k1", "k2", "rep", "node", F.coalesce("root", "node").alias("root")), "members")
    heads = members.groupBy("root").agg(F.min("rep").alias("class_id"), F.min_by("node", "rep").alias("head"))
    classes = members.join(heads, "root").select("k1", "k2", "class_id", "head")
    stays = F.col("class_id").isNull() | (F.col("id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("head")))
    out = written(sketches.join(classes, ["k1", "k2"], "left").select("id", "key", "class_id", stays.alias("stays")), "classes")
    drop_written(sketches, reps, pairs, links, nodes, heads, more, left, members)
    return out


def near_duplicate_classes(
    df: DataFrame,
    ident: str = "doc_id",
    text: str = "text",
    n: int = 5,
    similarity: float = 0.8,
    tables: int = 2,
    budget: int = 4,
    dense: int = 5000,
    chunk: int = 8 << 20,
) -> DataFrame:
    """Columns ``ident`` long, class_id long: the smallest ``ident`` that links reach; one row for each row of ``df``.

    Texts with the same words in the same order are one class from the start, so copies are never paired; texts without
    words are one such class. Rows with a null ``ident`` get the class of their words, or null, and link nothing. Rows that
    repeat an ``ident`` with other texts are compared text by text. An empty table gives an empty table; other columns are
    not read. Classes of over ``dense`` documents are dealt to chunks of ``chunk`` bytes where they fill a bucket; neither
    number changes the result.
    """
    return _classified(df, ident, text, n, similarity, tables, budget, dense, chunk).select(F.col("id").alias(ident), "class_id")


def one_of_each(df: DataFrame, ident: str = "doc_id", text: str = "text", n: int = 5, similarity: float = 0.8, tables: int = 2, budget: int = 4, dense: int = 5000, chunk: int = 8 << 20) -> DataFrame:
    """``df`` with one row of each class, that of the smallest ``ident``; all columns stay as they are.

    Rows are told apart by id and text. Rows with a null ``ident`` go if a row with one has the same words, else they stay;
    of rows with the same ``ident`` and text one stays.
    """
    classes = _classified(df, ident, text, n, similarity, tables, budget, dense, chunk)
    keyed = df.withColumn(KEY, row_key(F.col(ident).cast("long"), text_or_empty(text)))
    left = outside(keyed, written(classes.where("NOT stays").select(F.col("key").alias(KEY)).distinct(), "dropped"), KEY)
    repeated = written(classes.where("stays").groupBy(F.col("key").alias(KEY)).count().where("count > 1").select(KEY), "repeated")
    return one_of_repeated(left, repeated, KEY).drop(KEY)
