"""Exact deduplication with a cuckoo-filter index.

Texts are equal when they are identical without the characters [\\x20\\x09-\\x0D]. Every task keeps an index of the
digests it has seen: a cuckoo filter says "certainly new" or "perhaps known", a hit is verified against the digests kept
in the content bucket of that filter position, and only then counts as a copy. A full filter is doubled and refilled
from the stored keys. An index that reaches its bound gives out its oldest groups and deletes their digests, so a
task's memory does not grow with its input. The partial groups, one row for each digest and task however often a text
occurs, are dealt by digest bucket to the second round of indexes, which merge them.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafstack.llm._common import KEY, arrow_batches, one_of_repeated, outside, pieces, row_key, text_or_empty, written

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
SLOTS = 4
KICKS = 200


class CuckooIndex:
    """Live digests (bytes of at least 12, evenly distributed) with a value each."""

    def __init__(self, capacity: int = 1024):
        self.resizes = 0
        self._build(max(2, 1 << (max(capacity, 1) * 2 // SLOTS).bit_length()))

    def _build(self, buckets: int) -> None:
        self.buckets = buckets
        self.table = array("H", bytes(2 * SLOTS * buckets))
        self.content: dict[int, dict[bytes, object]] = {}
        self.size = 0

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[4:12], "little") & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 & (self.buckets - 1))

    def _marked(self, mark: int, a: int, b: int) -> bool:
        t = self.table
        return mark in t[SLOTS * a : SLOTS * a + SLOTS] or mark in t[SLOTS * b : SLOTS * b + SLOTS]

    def get(self, digest: bytes) -> object | None:
        """The value of a live digest: a filter hit, verified against the bucket's content."""
        mark, a, b = self._places(digest)
        return self.content.get(a, {}).get(digest) if self._marked(mark, a, b) else None

    def insert(self, digest: bytes, value: object) -> None:
        """``digest`` must not be live."""
        mark, a, b = self._places(digest)
        self.content.setdefault(a, {})[digest] = value
        self.size += 1
        if not self._place(mark, a, b):
            self._resize()

    def _place(self, mark: int, a: int, b: int) -> bool:
        t = self.table
        for bucket in (a, b):
            for slot in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                if not t[slot]:
                    t[slot] = mark
                    return True
        bucket = a
        for kick in range(KICKS):
            slot = SLOTS * bucket + (kick * 7 + mark) % SLOTS
            mark, t[slot] = t[slot], mark
            bucket = self._other(bucket, mark)
            for slot in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                if not t[slot]:
                    t[slot] = mark
                    return True
        return False

    def _resize(self) -> None:
        """Twice the buckets, refilled from the stored keys; the mark that was left over is among them."""
        live = list(self.items())
        buckets = self.buckets
        while True:
            buckets *= 2
            self.resizes += 1
            self._build(buckets)
            fits = True
            for digest, value in live:
                mark, a, b = self._places(digest)
                self.content.setdefault(a, {})[digest] = value
                self.size += 1
                fits = fits and self._place(mark, a, b)
            if fits:
                return

    def delete(self, digest: bytes) -> bool:
        """Remove a live digest; false, and no change, if it is not live."""
        mark, a, b = self._places(digest)
        held = self.content.get(a, {})
        if digest not in held:
            return False
        del held[digest]
        if not held:
            del self.content[a]
        for slot in (*range(SLOTS * a, SLOTS * a + SLOTS), *range(SLOTS * b, SLOTS * b + SLOTS)):
            if self.table[slot] == mark:
                self.table[slot] = 0
                break
        self.size -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        for held in self.content.values():
            yield from held.items()

    def __len__(self) -> int:
        return self.size


def digests(df: DataFrame, ident: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``ident``, digest binary (SHA-256 without white space), chars long (code points with it), ``keep`` (longs).

    A null text counts as empty.
    """
    arrow_batches(df.sparkSession)
    df = df.select(F.col(ident).cast("long").alias(ident), text, *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, text):
                texts = b.column(text).fill_null("")
                found = [hashlib.sha256(x.as_buffer().to_pybytes().translate(None, SPACES)).digest() for x in texts]
                columns = [b.column(ident), pa.array(found, pa.binary()), pc.utf8_length(texts).cast(pa.int64()), *(b.column(k) for k in keep)]
                yield pa.RecordBatch.from_arrays(columns, names=[ident, "digest", "chars", *keep])

    long = [T.StructField(k, T.LongType()) for k in (ident, "chars", *keep)]
    return df.mapInArrow(run, T.StructType([long[0], T.StructField("digest", T.BinaryType()), *long[1:]]))


_NONE = 1 << 63  # stands for a null id: larger than any, so a null stays only among nulls


class Grouper:
    """Merges (digest, count, chars, id) rows; gives out the oldest half of its groups when it holds ``bound``."""

    def __init__(self, bound: int | None):
        self.bound, self.index = bound, CuckooIndex()
        self.order: list[bytes] = []

    def add(self, batch: pa.RecordBatch) -> list[tuple[bytes, list]]:
        index, order = self.index, self.order
        for digest, n, chars, ident in zip(*(batch.column(c).to_pylist() for c in ("digest", "n", "chars", "ident"))):
            ident = _NONE if ident is None else ident
            group = index.get(digest)
            if group is None:
                index.insert(digest, [n, chars, ident])
                order.append(digest)
            else:
                group[0] += n
                if chars > group[1] or chars == group[1] and ident < group[2]:
                    group[1], group[2] = chars, ident
        out: list[tuple[bytes, list]] = []
        if self.bound and len(index) > self.bound:
            old, self.order = order[: len(order) // 2], order[len(order) // 2 :]
            for digest in old:
                out.append((digest, index.get(digest)))
                index.delete(digest)
        return out

    def rest(self) -> list[tuple[bytes, list]]:
        out = list(self.index.items())
        self.index, self.order = CuckooIndex(), []
        return out


def _group_batch(groups: list[tuple[bytes, list]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([d for d, _ in groups], pa.binary()),
            pa.array([g[0] for _, g in groups], pa.int64()),
            pa.array([g[1] for _, g in groups], pa.int64()),
            pa.array([None if g[2] == _NONE else g[2] for _, g in groups], pa.int64()),
        ],
        names=["digest", "n", "chars", "ident"],
    )


GROUP_SCHEMA = "digest binary, n long, chars long, ident long"


def groups(found: DataFrame, ident: str = "doc_id", bound: int = 100_000, bucket_rows: int = 5_000) -> DataFrame:
    """One row for each digest: digest, n long (rows), chars and ident of the row that stays."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grouper = Grouper(bound)
        for batch in batches:
            if out := grouper.add(batch):
                yield _group_batch(out)
        yield _group_batch(grouper.rest())

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grouper, bucket = Grouper(None), None
        for batch in batches:
            buckets = batch.column("bucket").to_numpy()
            cuts = [0, *(np.nonzero(np.diff(buckets))[0] + 1).tolist(), len(buckets)]
            for x, y in zip(cuts, cuts[1:]):
                if x == y:
                    continue
                if buckets[x] != bucket:
                    yield _group_batch(grouper.rest())
                    bucket = buckets[x]
                grouper.add(batch.slice(x, y - x))
        yield _group_batch(grouper.rest())

    one = F.lit(1).cast("long").alias("n")
    partial = found.select("digest", one, "chars", F.col(ident).alias("ident")).mapInArrow(first, GROUP_SCHEMA)
    buckets = 1 << max(0, (found.count() // bucket_rows)).bit_length()
    key = F.conv(F.hex(F.substring("digest", 13, 4)), 16, 10).cast("long") % buckets
    return partial.withColumn("bucket", key).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(second, GROUP_SCHEMA)


def _judged(df: DataFrame, ident: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``digests``, with n (rows), keep_id and keep_chars where a text occurs more than once."""
    found = written(digests(df, ident, text, keep), "digests")
    copied = groups(found, ident).where("n > 1").select("digest", "n", F.col("ident").alias("keep_id"), F.col("chars").alias("keep_chars"))
    return found.join(written(copied, "copied"), "digest", "left")


def exact_duplicates(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``ident`` long, keep_id long, group_size long, kept boolean, text_sha256 string; one row for each row of ``df``.

    Of equal texts the row with the most code points stays, then the one with the smallest ``ident``; a null ``ident``
    comes after every other, and texts that only such rows have keep a null keep_id with kept true. Rows that repeat an
    ``ident`` together with its text cannot be told apart and are all marked kept. Null and blank texts are equal texts.
    An empty table gives an empty table; other columns are not read.
    """
    out = _judged(df, ident, text)
    keep = F.when(F.col("n").isNull(), F.col(ident)).otherwise(F.col("keep_id"))
    return out.select(
        ident,
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.col(ident).eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_copies(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one row of each group of equal texts, the one that stays; all columns stay as they are.

    Rows are told apart by id and text: a row that repeats an id with an unequal text is not dropped with it, and of rows
    with the same id and equal texts, or with equal texts and no id, one of the longest stays.
    """
    keyed = df.withColumn(KEY, row_key(F.col(ident).cast("long"), text_or_empty(text)))
    judged = _judged(keyed, ident, text, (KEY,)).where("n IS NOT NULL")
    best = F.col(ident).eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))
    copies = written(judged.select("digest", KEY, best.alias("best")), "copies")
    winners = copies.where("best").groupBy("digest").agg(F.min(KEY).alias("winner"), (F.count("*") > 1).alias("shared"))
    marked = written(copies.join(winners, "digest").select(KEY, "winner", "shared"), "marked")
    left = outside(keyed, written(marked.where(F.col(KEY) != F.col("winner")).select(KEY).distinct(), "dropped"), KEY)
    repeated = marked.where(F.col("shared") & (F.col(KEY) == F.col("winner"))).groupBy(KEY).count().where("count > 1").select(KEY)
    return one_of_repeated(left, written(repeated, "repeated"), KEY).drop(KEY)
