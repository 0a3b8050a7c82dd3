"""Near-duplicate classes by MinHash with odd sketches.

A document is the set of its shingles. ``SAMPLES`` MinHash values stand for a set; the first of them, taken ``ROWS`` at a
time, are the keys of ``BANDS`` bands, and sets with an equal key meet. All samples are folded into an odd sketch: a bitmap
in which sample i with value v flips the bit that a hash of (i, v) names. Equal samples flip the same bit in two sketches, so
their exclusive or has only what samples that differ have flipped, and its population count tells how many those are, the
more precisely the more similar the sets. Two sets whose count is larger than sets at the similarity ever have (but for a
chance of ``MISS``) are not candidates. The parity sketch of a full set, in which each shingle flips a bit, goes after it: it
counts too few differing shingles and never too many, and so rules out no similar pair. What is left is confirmed on the
full sets.

Meeting sets are not paired off. First each set is held against the one of its companions that meets most others, which
links nearly all of a large class by one pair a member. Then only sets that are not linked so far are paired, in units that
hold a bounded number of sets, and only pairs that pass the sketch leave a unit.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafstack.llm import simhash
from leafstack.llm._common import arrow_batches, drop_written, inside, pieces, release_memory, text_or_empty, written
from leafstack.llm._units import Units, hashes, mixed
from leafstack.llm.components import components
from leafstack.llm.near_duplicates import Sketches, parity_sketch, shingle_sets

#: A pair at a Jaccard similarity of 0.85 shares no band with a probability of (1 - 0.85^6)^42 = 2e-9.
SAMPLES, BANDS, ROWS, BITS = 512, 42, 6, 1024
#: The chance with which an odd sketch rules out a pair at the similarity.
MISS = 1e-9
#: Sets of one key that are compared by one unit; more are dealt to pairs of chunks.
LARGE = 2000

_FACTORS = np.random.default_rng(simhash.SEED).integers(0, 1 << 31, SAMPLES, np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = np.random.default_rng(simhash.SEED + 1).integers(0, 1 << 32, SAMPLES, np.uint32)
_SLICE = 1 << 11


def shingles(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Of each text the distinct hashes of its ``n``-word shingles, ascending: words [^\\x20\\x09-\\x0D]+ with A-Z in lower case."""
    units = Units.of(texts)
    return shingle_sets(hashes(pc.ascii_lower(units.dictionary), simhash.SEED)[units.codes], units.bounds, n)


def samples(shingle_set: np.ndarray) -> np.ndarray:
    """The MinHash values of a set that is not empty, 32 bits each."""
    short = (shingle_set >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for x in range(0, len(short), _SLICE):
        np.minimum(least, (np.multiply.outer(short[x : x + _SLICE], _FACTORS) ^ _SHIFTS).min(axis=0), out=least)
    return least


def band_keys(values: np.ndarray) -> np.ndarray:
    """A row of ``BANDS`` 64-bit keys for each row of samples."""
    cut = values[:, : BANDS * ROWS].astype(np.uint64).reshape(len(values), BANDS, ROWS)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(values), BANDS)).copy()
    for k in range(ROWS):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, k], k)
    return out


def odd_sketches(values: np.ndarray, bits: int = BITS) -> np.ndarray:
    """A row of ``bits`` / 64 words for each row of samples."""
    named = mixed(values.astype(np.uint64) | np.arange(values.shape[1], dtype=np.uint64) << np.uint64(32), bits) >> np.uint64(64 - bits.bit_length() + 1)
    at = named.astype(np.int64) + np.arange(len(values))[:, None] * bits
    odd = np.bincount(at.ravel(), minlength=len(values) * bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<u8").reshape(len(values), bits // 64)


@functools.cache
def most_bits(similarity: float, count: int = SAMPLES, bits: int = BITS, miss: float = MISS) -> int:
    """The population count that two sets at ``similarity`` exceed with a probability of at most ``miss``.

    The number of samples that differ is binomial; each of them flips two bits at random, and the number of bits flipped an
    odd number of times is a walk that goes up with every bit not odd yet, and else down.
    """
    from math import exp, lgamma, log

    share, odd, total = np.arange(bits + 1) / bits, np.zeros(bits + 1), np.zeros(bits + 1)
    odd[0] = 1
    for differing in range(count + 1):
        if similarity < 1 or not differing:
            chance = lgamma(count + 1) - lgamma(differing + 1) - lgamma(count - differing + 1)
            chance += (count - differing) * log(similarity) + (differing * log(1 - similarity) if differing else 0)
            total += exp(chance) * odd
        for _ in range(2):
            odd = np.concatenate([[0], (odd * (1 - share))[:-1]]) + np.concatenate([(odd * share)[1:], [0]])
    beyond = np.cumsum(total[::-1])[::-1]  # probability of this count or more
    return int(np.nonzero(beyond > miss)[0][-1])


def similarity_of(bits_set: np.ndarray, count: int = SAMPLES, bits: int = BITS) -> np.ndarray:
    """The Jaccard similarity that population counts of two sketches' exclusive or speak for."""
    return 1 + np.log(np.maximum(1 - 2 * np.asarray(bits_set) / bits, 1e-12)) * bits / (4 * count)


def _sketched(df: DataFrame, ident: str, text: str, n: int) -> DataFrame:
    """One row for each row of ``df``: id, source long (a hash of the text), node long (a hash of the set; null if it is empty),
    size long, and bands, sketch and whole binary (once for a set in a batch). ``whole`` is the parity sketch of the full set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "text"):
                sets = shingles(b.column("text"), n)
                nodes = [xxhash.xxh3_64_intdigest(s.tobytes(), n) if len(s) else None for s in sets]
                first = {v: i for i, v in reversed(list(enumerate(nodes))) if v is not None}
                own = sorted(first.values())
                values = np.array([samples(sets[i]) for i in own], np.uint32).reshape(len(own), SAMPLES)
                kinds = [dict(zip(own, (row.tobytes() for row in rows))) for rows in (band_keys(values), odd_sketches(values))]
                kinds.append({i: parity_sketch(sets[i]) for i in own})
                blobs = [pa.array([kind.get(i) for i in range(b.num_rows)], pa.binary()) for kind in kinds]
                signed = [None if v is None else v - (1 << 64) if v >> 63 else v for v in nodes]
                columns = [b.column("id"), b.column("source"), pa.array(signed, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *blobs]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "source", "node", "size", "bands", "sketch", "whole"])
        release_memory()

    texts = df.select(F.col(ident).cast("long").alias("id"), text_or_empty(text).alias("text")).select("id", F.xxhash64("text").alias("source"), "text")
    return texts.mapInArrow(run, "id long, source long, node long, size long, bands binary, sketch binary, whole binary")


def _keys(nodes: DataFrame) -> DataFrame:
    """key long, node long: a row for each band of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.frombuffer(b"".join(b.column("bands").to_pylist()), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(b.column("node").to_numpy(), BANDS))], names=["key", "node"])

    return nodes.select("node", "bands").mapInArrow(run, "key long, node long")


def _leads(met: DataFrame) -> DataFrame:
    """Pairs a, b: each node with the companion that meets most others."""
    fame = met.groupBy("node").agg(F.sum("together").alias("fame"))
    known = met.join(fame, "node")
    leads = known.groupBy("key").agg(F.max(F.struct("fame", "node")).alias("lead"))
    best = known.select("key", "node").join(leads, "key").groupBy("node").agg(F.max("lead").alias("lead"))
    return best.select(F.col("node").alias("a"), F.col("lead.node").alias("b")).where("a <> b")


def _unlinked(met: DataFrame, nodes: DataFrame, roots: DataFrame, similarity: float, large: int) -> DataFrame:
    """Pairs a, b of nodes that share a key, have different roots, and pass both sketches.

    The rows of the root that a key has most often need not meet each other: they are dealt to chunks, and only the key's
    other rows are copied to each of these; those are also dealt to pairs of chunks of their own.
    """
    rooted = met.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    by_root = rooted.groupBy("key", "root").agg(F.count("*").alias("n"))
    by_key = by_root.groupBy("key").agg(F.max(F.struct("n", "root")).alias("hub"), F.sum("n").alias("all"), F.count("*").alias("roots")).where("roots > 1")
    chunks = lambda n: F.ceil(n / large).cast("int")
    open_keys = by_key.select("key", F.col("hub.root").alias("hub"), chunks(F.col("hub.n")).alias("hubs"), chunks(F.col("all") - F.col("hub.n")).alias("rests"))
    placed = rooted.join(open_keys, "key").withColumn("in_hub", F.col("root") == F.col("hub"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("in_hub"), F.col("hubs")).otherwise(F.col("rests"))).cast("int"))
    units_of = lambda count, unit: F.transform(F.sequence(F.lit(0), F.col(count) - 1), unit)
    unit = lambda kind, i, j, side: F.struct(F.xxhash64("key", F.lit(kind), i, j).alias("unit"), side.cast("int").alias("side"))
    own, side = F.col("own"), lambda o: F.when(F.col("own") == o, 0).when(F.col("own") < o, 1).otherwise(2)
    to_rest = units_of("rests", lambda o: unit(0, own, o, F.lit(1)))
    to_hub = units_of("hubs", lambda o: unit(0, o, own, F.lit(2)))
    among = units_of("rests", lambda o: unit(1, F.least(own, o), F.greatest(own, o), side(o)))
    dealt = placed.withColumn("u", F.explode(F.when(F.col("in_hub"), to_rest).otherwise(F.concat(to_hub, among))))
    units = dealt.select("u.unit", "u.side", "node", "root").join(nodes.select("node", "size", "sketch", "whole"), "node")
    most = most_bits(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in simhash.segments(batches, 20_000):
            unit, side, node, root, size = (t.column(c).to_numpy() for c in ("unit", "side", "node", "root", "size"))
            order = np.lexsort((root, unit))
            unit, side, node, root, size = (c[order] for c in (unit, side, node, root, size))
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), "<u8").reshape(-1, BITS // 64)[order]
            wholes = t.column("whole").to_pylist()
            whole = Sketches(size, np.frombuffer(b"".join([wholes[i] for i in order.tolist()]), "<u8"))
            new = np.concatenate([[True], (unit[1:] != unit[:-1]) | (root[1:] != root[:-1])])
            ends = np.concatenate([np.nonzero(new)[0][1:], [len(unit)]])
            start = ends[np.cumsum(new) - 1]  # behind the rows with the same root
            stop = np.searchsorted(unit, unit, "right")
            place = np.concatenate([[0], np.cumsum(stop - start)])
            x = 0
            while x < len(unit):
                y = max(x + 1, int(np.searchsorted(place, place[x] + (1 << 17), "right")) - 1)
                n = stop[x:y] - start[x:y]
                i = np.repeat(np.arange(x, y), n)
                j = np.arange(len(i)) + np.repeat(start[x:y] - (place[x:y] - place[x]), n)
                take = (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9) & ((side[i] == 0) | (side[i] != side[j]))
                i, j = i[take], j[take]
                near = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64) <= most
                i, j = i[near], j[near]
                near = whole.near(i, j, similarity)
                a, b = np.minimum(node[i[near]], node[j[near]]), np.maximum(node[i[near]], node[j[near]])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                x = y
        release_memory()

    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "a long, b long").distinct()


def _with_both(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` with the columns of ``table`` for either node, named c_a and c_b."""
    for k in "ab":
        pairs = pairs.join(table.select(F.col("node").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in columns)), k)
    return pairs


def _both(b: pa.RecordBatch, column: str) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer().to_pybytes() for k in "ab" for x in b.column(f"{column}_{k}")), "<u8")


def _candidates(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sizes and sketches allow the similarity."""
    most = most_bits(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two = _both(b, "sketch").reshape(2, b.num_rows, BITS // 64)
            near = np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64) <= most
            small, large = np.sort(np.stack([b.column("size_a").to_numpy(), b.column("size_b").to_numpy()]), axis=0)
            size, at = np.concatenate([b.column("size_a").to_numpy(), b.column("size_b").to_numpy()]), np.arange(b.num_rows)
            near &= Sketches(size, _both(b, "whole")).near(at, b.num_rows + at, similarity)
            yield b.select(["a", "b"]).filter(pa.array(near & (small >= similarity * large - 1e-9)))

    return _with_both(pairs, nodes, "size", "sketch", "whole").mapInArrow(run, "a long, b long")


def _sets(df: DataFrame, nodes: DataFrame, wanted: DataFrame, text: str, n: int) -> DataFrame:
    """node, shingles binary of the nodes ``wanted``, from one text each."""
    sources = written(nodes.join(wanted, "node", "left_semi").select("source"), "sources")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            new = [x not in seen and not seen.add(x) for x in batch.column("source").to_pylist()]
            for b in pieces(batch.filter(pa.array(new, pa.bool_())), "text"):
                sets = [s for s in shingles(b.column("text"), n) if len(s)]
                node = np.array([xxhash.xxh3_64_intdigest(s.tobytes(), n) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])
        release_memory()

    texts = df.select(text_or_empty(text).alias("text")).select(F.xxhash64("text").alias("source"), "text")
    rows = inside(texts, sources, "source").mapInArrow(run, "node long, shingles binary")
    return written(rows.dropDuplicates(["node"]), "sets")


def _confirmed(df: DataFrame, nodes: DataFrame, pairs: DataFrame, text: str, n: int, percent: int) -> DataFrame:
    """The pairs that are similar on their full sets: 100 x common shingles >= percent x all shingles."""
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted")
    sets = _sets(df, nodes, wanted, text, n)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("shingles_a"), b.column("shingles_b")):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([u, v])
                both.sort(kind="stable")  # two ascending runs
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = written(_with_both(pairs, sets, "shingles").mapInArrow(judge, "a long, b long"), "links")
    drop_written(wanted, sets)
    return links


def near_duplicates(df: DataFrame, ident: str = "doc_id", text: str = "text", n: int = 5, percent: int = 85, large: int = LARGE) -> DataFrame:
    """Columns ``ident`` long, n_shingles long, component_id long, kept boolean; one row for each row of ``df``.

    ``component_id`` is the smallest ``ident`` that links reach, itself included; ``percent`` (over 50) is the Jaccard
    similarity from which sets of ``n``-word shingles are linked, in hundredths. A text of fewer words is one shingle. Null
    and blank texts have none, link nothing and stand for themselves. Equal sets, as of exact copies, are one node and are
    not paired. Rows that repeat an ``ident`` with other texts are linked text by text. A row with a null ``ident`` has the
    component of its set (null if no row of it has an id) and is kept only then. Other columns are not read; an empty table
    gives an empty table. ``large`` bounds the sets that one unit compares and does not change the result.

    A pair right at 85 % is missed with a probability of 2e-9 by the bands and ``MISS`` by the sketch, more similar ones with
    a far smaller one.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent is more than 50 and at most 100")
    arrow_batches(df.sparkSession)
    rows = written(_sketched(df, ident, text, n), "sketches")
    first = [F.first(c, ignorenulls=True).alias(c) for c in ("size", "bands", "sketch", "whole")]
    nodes = written(rows.where("bands IS NOT NULL").groupBy("node").agg(F.min("source").alias("source"), *first), "nodes")
    keys = _keys(nodes)
    shared = keys.groupBy("key").agg(F.count("*").alias("together")).where("together > 1")
    met = written(keys.join(shared, "key"), "met")
    leads = written(_candidates(_leads(met), nodes, percent / 100), "leads")
    links = _confirmed(df, nodes, leads, text, n, percent)
    more = written(_unlinked(met, nodes, components(links), percent / 100, large), "unlinked")
    roots = components(links.unionByName(_confirmed(df, nodes, more, text, n, percent)))
    ids = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("rep")).join(roots, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    ids = written(ids, "classes")
    classes = ids.join(ids.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("node", "component_id")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    out = written(rows.select("id", "node", "size").join(classes, "node", "left").select(F.col("id").alias(ident), F.col("size").alias("n_shingles"), component.alias("component_id")), "components")
    drop_written(rows, nodes, met, leads, links, more, ids)
    return out.withColumn("kept", F.coalesce(F.col(ident) == F.col("component_id"), F.col("component_id").isNull()))
