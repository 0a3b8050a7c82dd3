"""Token-id output compressed by Re-Pair grammars.

Documents are encoded in ascending id order into shards of about ``shard_bytes`` of text, and each shard is one grammar:
rules that replace a frequent pair of symbols by a new one, and the symbols left. Every round counts the neighbouring
pairs of the shard, gives each pair that reaches the round's threshold a rule, and replaces its occurrences from the left;
rounds repeat until no pair reaches it, and thresholds fall to 5. A rule takes two symbols of some 17 bits and every
occurrence saves one, so it pays from 3 on; the pairs that occur 3 or 4 times are so many that symbols would need a bit
more, which costs more than they save (measured: 1.05 bytes an id against 1.00). Pairs inside a word are counted once for
each distinct word and weighted by its occurrences; the last rounds count across words. A document's end id never starts
a pair, so the symbols of a document are a range of their shard and any document, or any id position, is decoded alone.

Shard format, all little-endian: magic ``RPG2``; seven unsigned 32-bit counts (first rule symbol, rules, rounds, symbols,
documents, ids, bits of a symbol); per round the number of rules up to it; per document the end of its symbols; then the
left and the right symbols of the rules, and the symbols, each as a plane of 16-bit numbers and, for each further bit, a
plane of single bits. How many ids a rule stands for follows from the rules.

Defined results: a null or empty text is the end id alone; repeated rows are written repeatedly; rows with a null id
come first; rows that share an id are ordered by a hash of their text; an empty table gives an empty table. A shard holds
whole documents, so one that is longer than ``shard_bytes`` is a shard of its own.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafstack.llm._common import arrow_batches, pieces, release_memory, written
from leafstack.llm._units import Units, gather, ragged
from leafstack.llm.speculative_bpe import WordBpe, byte_level, ids_of_units

MAGIC = b"RPG2"
WORD_THRESHOLDS = (600, 40, 10, 5)
TEXT_THRESHOLDS = (100, 20, 5)
_HASH_BITS = 20


def replace_pairs(symbols: np.ndarray, last: np.ndarray, weight: np.ndarray | None, new: int, least: int, since: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """One round: rules for the pairs that occur ``least`` times, and what is left after replacing them.

    ``last``: whether a symbol ends its segment, so that no pair starts there. ``weight``: how often each symbol's segment
    occurs. Only pairs with a symbol from ``since`` on are counted: a round leaves no occurrence of the pairs it replaces,
    so the next round of the same ``least`` need only look at new symbols. Returns (rules as rows of two symbols, symbols,
    last, weight). Counts by hash come first, and only pairs whose hash reaches ``least`` are sorted.
    """
    inside = ~last[:-1]
    if since:
        fresh = symbols >= since
        inside &= fresh[:-1] | fresh[1:]
    at = np.nonzero(inside)[0]
    keys = symbols[at].astype(np.int64) << 24 | symbols[at + 1]
    hashed = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _HASH_BITS)).astype(np.int64)
    w = None if weight is None else weight[at]
    often = (np.bincount(hashed, weights=w, minlength=1 << _HASH_BITS) >= least)[hashed]
    at, keys, w = at[often], keys[often], None if w is None else w[often]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    head = np.concatenate([np.ones(min(len(ranked), 1), bool), ranked[1:] != ranked[:-1]])
    start = np.nonzero(head)[0]
    count = np.diff(np.append(start, len(ranked))) if w is None else np.add.reduceat(w[order], start) if len(start) else w
    good = count >= least
    rules = np.column_stack([ranked[start[good]] >> 24, ranked[start[good]] & 0xFFFFFF])
    if not len(rules):
        return rules, symbols, last, weight
    group = np.cumsum(head) - 1
    rule = np.full(len(keys), -1)
    rule[order] = np.where(good, np.cumsum(good) - 1, -1)[group]
    at, rule = at[rule >= 0], rule[rule >= 0]
    # of occurrences that overlap in a row, every other one is replaced
    place = np.arange(len(at))
    run = place - np.maximum.accumulate(np.where(np.concatenate([[True], np.diff(at) != 1]), place, 0))
    at, rule = at[run % 2 == 0], rule[run % 2 == 0]
    symbols, last = symbols.copy(), last.copy()
    symbols[at] = new + rule
    last[at] = last[at + 1]
    stay = np.ones(len(symbols), bool)
    stay[at + 1] = False
    return rules, symbols[stay], last[stay], None if weight is None else weight[stay]


def _packed(values: np.ndarray, bits: int) -> bytes:
    planes = [np.packbits((values >> k & 1).astype(np.uint8), bitorder="little").tobytes() for k in range(16, bits)]
    return (values & 0xFFFF).astype("<u2").tobytes() + b"".join(planes)


class Grammar:
    """A shard: ``rules[k]`` is what symbol ``first + k`` stands for; ``ends`` are the documents' ends in ``symbols``."""

    def __init__(self, first: int, rules: np.ndarray, rounds: np.ndarray, symbols: np.ndarray, ends: np.ndarray):
        self.first, self.rules, self.rounds, self.symbols, self.ends = first, rules, rounds, symbols, ends

    @classmethod
    def of(cls, units: Units, flat: np.ndarray, lengths: np.ndarray, first: int, end: int) -> Grammar:
        """``flat``, ``lengths``: the ids of each distinct unit; ``end`` is added to each document; all ids are below ``first``."""
        rules, rounds = [np.zeros((0, 2), np.int64)], [0]

        def play(symbols, last, weight, thresholds):
            for least in thresholds:
                since = 0
                while True:
                    new = first + rounds[-1]
                    found, symbols, last, weight = replace_pairs(symbols, last, weight, new, least, since)
                    if not len(found):
                        break
                    rules.append(found)
                    rounds.append(rounds[-1] + len(found))
                    since = new
            return symbols, last

        occurs = np.bincount(units.codes, minlength=len(lengths)).astype(np.float64)
        full = lengths > 0
        last = np.zeros(len(flat), bool)
        last[np.cumsum(lengths[full]) - 1] = True
        inner, last = play(flat.astype(np.int32), last, np.repeat(occurs, lengths), WORD_THRESHOLDS)
        left = np.zeros(len(lengths), np.int64)
        left[full] = np.diff(np.concatenate([[-1], np.nonzero(last)[0]]))
        symbols, bounds = gather(inner, left, units.codes, units.bounds)
        symbols = np.insert(symbols, bounds[1:], end).astype(np.int32)
        closing = np.cumsum(np.diff(bounds) + 1) - 1
        last = np.zeros(len(symbols), bool)
        last[closing] = True
        last[closing[closing > 0] - 1] = True  # so an end id is a segment of its own
        symbols, last = play(symbols, last, None, TEXT_THRESHOLDS)
        filled = np.diff(bounds) > 0  # a document is a segment, if it is not empty, and its end id another
        segments = np.nonzero(last)[0]
        ends = segments[np.cumsum(1 + filled.astype(np.int64)) - 1] + 1
        return cls(first, np.concatenate(rules), np.array(rounds[1:], np.int64), symbols, ends)

    @functools.cached_property
    def sizes(self) -> np.ndarray:
        """The number of ids that each symbol stands for."""
        out, done = np.ones(self.first + len(self.rules), np.int64), 0
        for upto in self.rounds.tolist():
            out[self.first + done : self.first + upto] = out[self.rules[done:upto]].sum(axis=1)
            done = upto
        return out

    def expansions(self) -> np.ndarray:
        """The ids that each symbol stands for, joined."""
        flat, done = np.arange(self.first, dtype=np.int32), 0
        for upto in self.rounds.tolist():
            parts, _ = gather(flat, self.sizes[: self.first + done], self.rules[done:upto].ravel(), np.zeros(1, np.int64))
            flat, done = np.concatenate([flat, parts]), upto
        return flat

    def decode(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the documents' bounds in them."""
        return gather(self.expansions(), self.sizes, self.symbols, np.concatenate([[0], self.ends]))

    def document(self, k: int) -> np.ndarray:
        """The ids of one document, from its own symbols and the rules they need."""
        return self._expand(self.symbols[self.ends[k - 1] if k else 0 : self.ends[k]])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids at positions start to stop of the shard, without decoding what is before or after."""
        ends = np.cumsum(self.sizes[self.symbols])
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skip = start - (ends[a - 1] if a else 0)
        return self._expand(self.symbols[a:b])[skip : skip + stop - start]

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        while (big := symbols >= self.first).any():
            out = np.zeros(len(symbols) + big.sum(), np.int64)
            at = np.arange(len(symbols)) + np.cumsum(big) - big
            out[at[~big]] = symbols[~big]
            out[at[big]], out[at[big] + 1] = self.rules[symbols[big] - self.first].T
            symbols = out
        return symbols

    @property
    def n_ids(self) -> int:
        return int(self.sizes[self.symbols].sum())

    def to_bytes(self) -> bytes:
        bits = max(16, (self.first + len(self.rules)).bit_length())
        head = [self.first, len(self.rules), len(self.rounds), len(self.symbols), len(self.ends), self.n_ids, bits]
        numbers = b"".join(np.ascontiguousarray(x, "<u4").tobytes() for x in (head, self.rounds, self.ends))
        return MAGIC + numbers + b"".join(_packed(x, bits) for x in (self.rules[:, 0], self.rules[:, 1], self.symbols))

    @classmethod
    def from_bytes(cls, data: bytes) -> Grammar:
        if data[:4] != MAGIC:
            raise ValueError("not a grammar shard")
        first, n_rules, n_rounds, n_symbols, n_docs, _, bits = np.frombuffer(data, "<u4", 7, 4).tolist()
        at = 32

        def take(n, kind="<u4"):
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        def unpacked(n):
            out = take(n, "<u2").astype(np.int32)
            for k in range(16, bits):
                out |= np.unpackbits(take(-(-n // 8), "u1"), count=n, bitorder="little").astype(np.int32) << k
            return out

        rounds, ends = take(n_rounds).astype(np.int64), take(n_docs).astype(np.int64)
        left, right = unpacked(n_rules), unpacked(n_rules)
        return cls(first, np.column_stack([left, right]).astype(np.int64), rounds, unpacked(n_symbols), ends)


class Library:
    """Ids of units by the tokenizers library, whose model merges each distinct word of a shard once; one per worker process."""

    def __init__(self, path: str):
        self.bpe = WordBpe(path)
        # the library merges, so the worker need not keep a second copy of the vocabulary
        self.bpe.merges, self.bpe.inner, self.bpe.final, self.bpe.strings = {}, {}, {}, []
        release_memory()
        self.above = self.bpe.library.get_vocab_size(with_added_tokens=True)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        tokenize = self.bpe.library.model.tokenize
        return ragged([[t.id for t in tokenize(w if w.isascii() else byte_level(w))] if w else [] for w in words.to_pylist()])

    def _others(self, units: list[str]) -> list[list[int]]:
        ids = lambda w: [w] if isinstance(w, int) else [t.id for t in self.bpe.library.model.tokenize(w)]
        return [[i for w in self.bpe.pretokens(u) for i in ids(w)] for u in units]

    def rows(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units, joined, and how many each has."""
        return ids_of_units(units, self._words, self._others)


@functools.cache
def _library(path: str) -> Library:
    return Library(path)


BLOCK_SCHEMA = "part int, shard int, doc_ids array<long>, n_ids array<long>, payload binary"
#: Parts of the output that tasks write one after the other, each any number of shards; one row for each reaches the driver.
MOST_PARTS = 8192


def encode_blocks(df: DataFrame, path: str, ident: str = "doc_id", text: str = "text", end: int = 2, shard_bytes: int = 8 << 20) -> DataFrame:
    """``df`` as rows (part, shard, doc_ids, n_ids, payload), in order; the payload is a ``Grammar`` in bytes.

    Parts are of about ``shard_bytes`` as the planner counts (bytes of the files that ``df`` reads) until there are
    ``MOST_PARTS``, then larger; a part is cut into shards of at most twice ``shard_bytes`` of text.
    """
    spark = df.sparkSession
    arrow_batches(spark)
    total = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    df = df.select(F.col(ident).alias("ident"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if total > 1 << 55:  # the planner does not know
        total = df.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    parts = min(total // shard_bytes + 1, MOST_PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _library(path)
        part, shard = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            units = Units.of(t.column("text").chunk(0) if t.num_rows else pa.array([], pa.string()))
            ids = t.column("ident").to_pylist()
            del t
            flat, lengths = library.rows(units.dictionary)
            units.dictionary = None
            sizes = lengths[units.codes] if len(units.codes) else np.zeros(0, np.int64)
            n_ids = np.diff(np.concatenate([[0], np.cumsum(sizes)])[units.bounds]) + 1
            payload = Grammar.of(units, flat, lengths, library.above, end).to_bytes()
            lists = [pa.array([x], pa.list_(pa.int64())) for x in (ids, n_ids.tolist())]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), *lists, pa.array([payload], pa.binary())], names=["part", "shard", "doc_ids", "n_ids", "payload"])

        for batch in batches:
            for b in pieces(batch, "text", shard_bytes):
                n = pc.sum(pc.binary_length(b.column("text"))).as_py() or 0
                if held and size + n > 2 * shard_bytes:
                    yield out()
                    release_memory()
                    size, shard = 0, shard + 1
                held.append(b)
                size += n
        if held:
            yield out()
        release_memory()

    # rows alike in id and text may go to any place among each other, so a hot id or text is dealt to several parts
    keys = {"tie": F.xxhash64("text"), "nth": F.monotonically_increasing_id()}
    ordered = df.withColumns(keys).repartitionByRange(parts, "ident", "tie", "nth").sortWithinPartitions("ident", "tie", "nth")
    return ordered.select("ident", "text").mapInArrow(run, BLOCK_SCHEMA)


def read_blocks(blocks: DataFrame) -> DataFrame:
    """Decode written blocks: doc_id long, start long (ids of all documents before it), n_tokens long, ids_crc32 long."""
    spark = blocks.sparkSession
    arrow_batches(spark)
    sized = blocks.select("part", "shard", F.aggregate("n_ids", F.lit(0).cast("long"), lambda x, y: x + y).alias("total"))
    # at most MOST_PARTS rows
    totals = sorted(tuple(r) for r in sized.groupBy("part").agg(F.sum("total").alias("total"), F.count("*").alias("shards")).collect())
    rows, at = [], 0
    for part, total, _ in totals:
        rows.append((part, at))
        at += total
    earlier = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    place = sized.withColumn("inside", F.coalesce(F.sum("total").over(earlier), F.lit(0))).join(F.broadcast(spark.createDataFrame(rows, "part int, before long")), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                grammar = Grammar.from_bytes(b.column("payload")[row].as_buffer())
                ids, bounds = grammar.decode()
                data, ends = memoryview(ids.astype("<u4").tobytes()), bounds.tolist()
                crc = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_ids")[row].values, pa.array(bounds[:-1] + b.column("offset")[row].as_py(), pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )
        release_memory()

    place = place.select("part", "shard", (F.col("before") + F.col("inside")).alias("offset"))
    few = sum(n for _, _, n in totals) <= 100_000  # rows of three numbers
    placed = blocks.select("part", "shard", "doc_ids", "payload").join(F.broadcast(place) if few else place, ["part", "shard"])
    return placed.select("offset", "doc_ids", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(df: DataFrame, path: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode ``df``, write its blocks to the shared scratch folder, and decode them from there."""
    return read_blocks(written(encode_blocks(df, path, ident, text), "token_blocks"))
