"""Benchmark decontamination by template canonicalisation.

Words lose their case and the marks at their ends; numbers, units and, in a second reading, capitalised names become
typed placeholders. Every run of ``window`` tokens of a benchmark item is a template window (an item with fewer tokens is
one window). Windows of a text that hash like one of these are joined with it, and the pair counts if the fillers of its
placeholders map to each other one to one, so a question asked again with other numbers or names is found, and prose
that only has the same shape is not. A window with fewer than ``literal`` ordinary words, and an item with fewer than
``least`` tokens, has too little shape for that: it counts only with its own fillers, that is as a copy.

Only windows that can match leave a task: below ``bound`` benchmark windows their hashes are sent to all tasks and the
windows are broadcast; above it a bitmap of fixed size is sent and the windows are joined by shuffling.

Defined results: one row for each text and item that share a window, so none for null, empty or clean texts; an item of
one or two tokens is a word and not a passage, so it has no window; rows that share an item id are one item with the
windows of all their texts; repeated rows of one id count once, null ids together; empty tables give an empty table;
other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafstack.llm._common import KEY, arrow_batches, outside, pieces, release_memory, row_key, text_or_empty, written
from leafstack.llm._units import ASCII_MARKS, Units, gather, hashes

#: Words that are units of measure. Fixed values.
UNIT_WORDS = frozenset(
    """mm cm km mg kg ml kwh mph kmh hz khz mhz ghz kb mb gb tb
    meter meters metre metres centimeter centimeters kilometer kilometers kilometre kilometres inch inches foot feet yard yards mile miles
    gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres gallon gallons
    second seconds minute minutes hour hours day days week weeks month months year years
    dollar dollars cent cents euro euros percent degrees""".split()
)

_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_QUANTITY = re.compile(r"([+\-]?\d[\d.,:/]*)([^\W\d]+)?")
_CURRENCY = "$€£¥%"
WORD, NUMBER, UNIT, NAME = range(4)


def tokens_of(unit: str) -> list[tuple[int, str]]:
    """(kind, word) of a whitespace-separated unit; a number with a unit or a currency sign is two tokens."""
    if unit.isalpha():
        low = unit.lower()
        if low in UNIT_WORDS:
            return [(UNIT, low)]
        return [(NAME if len(unit) > 1 and unit[0].isupper() and unit[1:].islower() else WORD, low)]
    bare = _EDGES.sub("", unit)
    if not bare:
        return []
    if m := _QUANTITY.fullmatch(bare):
        out = [(NUMBER, m[1].rstrip(".,:/"))]
        if m[2]:
            out.append((UNIT if m[2].lower() in UNIT_WORDS or len(m[2]) <= 2 else WORD, m[2].lower()))
        sign = next((c for c in unit if c in _CURRENCY), "")
        return [*out, (UNIT, sign)] if sign else out
    return tokens_of(bare) if bare.isalpha() else [(WORD, bare.lower())]


_SIMPLE = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
_TITLE = "^[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+$"
_HOLDERS = hashes(pa.array([f"\x00{kind}" for kind in range(4)]), 7).view(np.int64)  # of the placeholder of each kind


def canonical(units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all units, joined, as hashes in the plain and in the named reading; and how many each unit has.

    A number, unit or (in the named reading) name is its placeholder. Units of letters and ASCII marks need no Python.
    """
    bare = pc.utf8_trim(units, characters=ASCII_MARKS)
    simple = pc.match_substring_regex(bare, _SIMPLE).to_numpy(zero_copy_only=False)
    empty = pc.and_(pc.equal(pc.binary_length(bare), 0), pc.string_is_ascii(units)).to_numpy(zero_copy_only=False)
    other = [tokens_of(u) for u in units.filter(pa.array(~simple & ~empty)).to_pylist()]
    lengths = simple.astype(np.int64)
    lengths[~simple & ~empty] = [len(t) for t in other]
    start = np.concatenate([[0], np.cumsum(lengths)])
    plain = np.zeros(start[-1], np.int64)
    own = bare.filter(pa.array(simple))
    low = pc.utf8_lower(own)
    h = hashes(low, 7).view(np.int64)
    h[pc.is_in(low, value_set=pa.array(sorted(UNIT_WORDS))).to_numpy(zero_copy_only=False)] = _HOLDERS[UNIT]
    plain[start[:-1][simple]] = h
    named = plain.copy()
    title = pc.match_substring_regex(own, _TITLE).to_numpy(zero_copy_only=False) & (h != _HOLDERS[UNIT])
    named[start[:-1][simple][title]] = _HOLDERS[NAME]
    if tokens := [t for ts in other for t in ts]:
        kind = np.array([k for k, _ in tokens])
        at = np.concatenate([np.arange(x, y) for x, y in zip(start[:-1][~simple & ~empty].tolist(), start[1:][~simple & ~empty].tolist())])
        h = hashes(pa.array([w for _, w in tokens], pa.string()), 7).view(np.int64)
        plain[at] = np.where((kind == NUMBER) | (kind == UNIT), _HOLDERS[kind], h)
        named[at] = np.where(kind != WORD, _HOLDERS[kind], h)
    return plain, named, lengths


def read(texts: pa.Array) -> tuple[Units, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units; token hashes of the plain and of the named reading; bounds of the texts in tokens; unit of each token."""
    units = Units.of(texts)
    plain, named, lengths = canonical(units.dictionary)
    at, bounds = gather(np.arange(len(plain)), lengths, units.codes, units.bounds)
    unit_of = np.repeat(np.arange(len(units.codes)), lengths[units.codes]) if len(units.codes) else units.codes
    return units, plain[at], named[at], bounds, unit_of


_BASE = 0x9E3779B97F4A7C15 | 1


def window_hashes(tokens: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` tokens (across texts too; the caller drops those).

    Runs of 1, 2, 4, ... tokens are hashed by joining halves, and the runs that make up ``size`` are joined.
    """
    if len(tokens) < size:
        return np.zeros(0, np.int64)
    part, length, done, total, mask = tokens.view(np.uint64), 1, None, 0, (1 << 64) - 1
    while length <= size:
        if size & length:
            done = part if done is None else done[: len(part) - total] * np.uint64(pow(_BASE, length, mask + 1)) + part[total:]
            total += length
        if 2 * length <= size:
            part = part[:-length] * np.uint64(pow(_BASE, length, mask + 1)) + part[length:]
        length *= 2
    out = done[: len(tokens) - size + 1].copy()
    out ^= out >> np.uint64(29)
    return (out * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(size)).view(np.int64)


WINDOW_FIELDS = (("hash", T.LongType()), ("named", T.BooleanType()), ("at", T.LongType()), ("slots", T.ArrayType(T.StringType())), ("literals", T.IntegerType()))


def _windows(b: pa.RecordBatch, ident: str, text: str, sizes, wanted) -> Iterator[pa.RecordBatch]:
    """Rows of the windows of a batch whose sizes (per text) and hashes are wanted."""
    units, plain, named, bounds, unit_of = read(b.column(text).fill_null(""))
    n_tokens = np.diff(bounds)
    text_of = np.repeat(np.arange(len(n_tokens)), n_tokens)
    cache: dict[int, list[tuple[int, str]]] = {}
    for size in sizes:
        for kind, tokens in ((False, plain), (True, named)):
            found = window_hashes(tokens, size)
            start = np.nonzero(wanted(size, found, text_of, n_tokens))[0]
            start = start[text_of[start] == text_of[start + size - 1]] if len(start) else start
            slots, literals = [], []
            for s in start.tolist():
                window: list[tuple[int, str]] = []
                for u in dict.fromkeys(unit_of[s : s + size].tolist()):
                    code = int(units.codes[u])
                    if code not in cache:
                        cache[code] = tokens_of(units.dictionary[code].as_py())
                    skip = s - int(np.searchsorted(unit_of, u)) if not window else 0
                    window += cache[code][max(skip, 0) :]
                window = window[:size]
                open_kinds = (NUMBER, UNIT, NAME) if kind else (NUMBER, UNIT)
                slots.append([f"{k}{w}" for k, w in window if k in open_kinds])
                literals.append(sum(k not in open_kinds for k, _ in window))
            if len(start):
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(ident).take(pa.array(text_of[start])),
                        pa.array(found[start]),
                        pa.array([kind] * len(start)),
                        pa.array(start - bounds[:-1][text_of[start]], pa.int64()),
                        pa.array(slots, pa.list_(pa.string())),
                        pa.array(literals, pa.int32()),
                    ],
                    names=[ident, *(f for f, _ in WINDOW_FIELDS)],
                )


def _schema(df: DataFrame, ident: str) -> T.StructType:
    return T.StructType([df.schema[ident], *(T.StructField(*f) for f in WINDOW_FIELDS)])


#: Items with fewer tokens name a thing and are no passage.
SHORTEST = 3


def template_windows(items: DataFrame, ident: str = "item_id", text: str = "text", window: int = 13, least: int = 8, literal: int = 7) -> DataFrame:
    """Rows ``ident``, row (of the item's text), hash, named, at, slots, literals, size, strict (only its own fillers count)."""
    items = items.select(ident, text_or_empty(text).alias(text)).distinct()
    keyed = items.select(F.struct(F.col(ident).alias("item"), F.xxhash64(text).alias("row")).alias("_item"), text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size in range(SHORTEST, window + 1):
                fits = lambda s, h, text_of, n: n[text_of[: len(h)]] >= s if s == window else n[text_of[: len(h)]] == s
                for out in _windows(batch, "_item", text, [size], fits):
                    yield out.append_column("size", pa.array([size] * out.num_rows, pa.int32()))

    rows = keyed.mapInArrow(run, _schema(keyed, "_item").add("size", T.IntegerType()))
    strict = (F.col("literals") < F.least(F.lit(literal), F.col("size") / 2)) | (F.col("size") < least)
    return rows.select(F.col("_item.item").alias(ident), F.col("_item.row").alias("row"), *(f for f, _ in WINDOW_FIELDS), "size", strict.alias("strict"))


#: Bits of the map of window hashes that is sent when they are too many, as a power of two.
MAP_BITS = 26


def _bitmap(bench: DataFrame) -> np.ndarray:
    """Which hashes, by their first bits, the benchmark has; as many bytes at most reach the driver as the map has."""
    at = F.shiftrightunsigned("hash", 64 - MAP_BITS)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
    words = bench.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(1 << MAP_BITS - 6, "<i8")
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint8)


def contaminated(df: DataFrame, items: DataFrame, ident: str = "doc_id", item: str = "item_id", text: str = "text", window: int = 13, least: int = 8, literal: int = 7, bound: int = 500_000) -> DataFrame:
    """Columns ``ident``, ``item``, windows long, coverage double, first long, last long (tokens), altered boolean.

    windows and coverage: the windows of the item that the text has, and their share of all; altered: one of
    them is there only with other fillers than the item's own.
    """
    spark = df.sparkSession
    arrow_batches(spark)
    bench = template_windows(items, item, text, window, least, literal).withColumnsRenamed({"slots": "item_slots", "at": "item_at", item: "_item", "row": "item_row"}).drop("literals")
    bench = written(bench, "template_windows")
    small = bench.count() <= bound
    sizes = sorted(r["size"] for r in bench.select("size").distinct().collect())
    known = np.unique(np.array([r.hash for r in bench.select("hash").distinct().collect()], np.int64)) if small else _bitmap(bench)
    shared = spark.sparkContext.broadcast(known)  # ``bound`` numbers, or the map
    df = df.select(ident, text_or_empty(text).alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        if small:
            marked = np.zeros(1 << 20, bool)
            marked[(known.view(np.uint64) >> np.uint64(44)).astype(np.int64)] = True

        def wanted(size, found, text_of, n_tokens):
            if not small:
                place = (found.view(np.uint64) >> np.uint64(64 - MAP_BITS)).astype(np.int64)
                return (known[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
            out = marked[(found.view(np.uint64) >> np.uint64(44)).astype(np.int64)]
            at = np.nonzero(out)[0]
            place = np.minimum(np.searchsorted(known, found[at]), len(known) - 1)
            out[at] = known[place] == found[at]
            return out

        for batch in batches:
            for b in pieces(batch, text):
                yield from _windows(b, ident, text, sizes, wanted)
        release_memory()

    found = df.mapInArrow(run, _schema(df, ident)).drop("literals")
    pairs = found.join(F.broadcast(bench) if small else bench, ["hash", "named"])
    both = F.arrays_zip("slots", "item_slots")
    one_to_one = (F.size(F.array_distinct(both)) == F.size(F.array_distinct("slots"))) & (F.size(F.array_distinct(both)) == F.size(F.array_distinct("item_slots")))
    same = F.col("slots") == F.col("item_slots")
    hits = pairs.where((F.size("slots") == F.size("item_slots")) & F.when(F.col("strict"), same).otherwise(one_to_one))
    by_window = hits.groupBy(ident, "_item", "item_row", "item_at").agg(F.min("at").alias("lo"), F.max(F.col("at") + F.col("size") - 1).alias("hi"), F.max(same.cast("int")).alias("same"))
    totals = bench.select("_item", "item_row", "item_at").distinct().groupBy("_item").agg(F.count("*").alias("total"))
    out = by_window.groupBy(ident, "_item").agg(F.count("*").alias("windows"), F.min("lo").alias("first"), F.max("hi").alias("last"), F.min("same").alias("same"))
    joined = out.alias("o").join((F.broadcast(totals) if small else totals).alias("t"), F.col("o._item").eqNullSafe(F.col("t._item")))
    return joined.select(F.col(f"o.{ident}").alias(ident), F.col("o._item").alias(item), "windows", F.round(F.col("windows") / F.col("total"), 4).alias("coverage"), "first", "last", (F.col("same") == 0).alias("altered"))


def without_contaminated(df: DataFrame, items: DataFrame, ident: str = "doc_id", item: str = "item_id", text: str = "text", **settings) -> DataFrame:
    """``df`` without the rows that share a window with an item. Rows are told apart by id and text, with or without an id."""
    keyed = df.withColumn(KEY, row_key(F.col(ident).cast("long"), text_or_empty(text)))
    found = contaminated(keyed.select(KEY, text), items, KEY, item, text, **settings).select(KEY).distinct()
    return outside(keyed, written(found, "contaminated"), KEY).drop(KEY)
