"""Shared plumbing of the training-data operators: scratch tables, Arrow batch sizes, input columns."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SCRATCH: list[tuple[SparkSession, str]] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a temporary folder serves if driver and executors are one process; a cluster must name a folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _local_root()
    return root.rstrip("/")


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="leafstack-")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/leafstack/{uuid.uuid4().hex}/{name}"
    _SCRATCH.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df``: write it to the shared scratch folder and read it back.

    The table is on shared storage, so a lost executor costs a re-read and not a recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._leafstack_path = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Delete scratch tables that no plan reads any more."""
    for t in tables:
        path = getattr(t, "_leafstack_path", None)
        if path:
            _delete(t.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target.getParent(), True)


def clear_scratch() -> None:
    """Delete every scratch table of this process; results that still read them become unusable."""
    while _SCRATCH:
        spark, path = _SCRATCH.pop()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may already be gone at interpreter exit
            return


atexit.register(clear_scratch)


#: What Spark puts in one Arrow batch for a Python worker: long texts would make its default too large.
BATCH_ROWS, BATCH_BYTES = 10_000, 4 << 20


def arrow_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes. Always the same values, so plans that run later are not changed by plans made since."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def pieces(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row ranges whose ``column`` holds about ``max_bytes``; a single longer text stays whole."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def release_memory() -> None:
    """Give memory that a worker has freed back to the system; its allocators would keep it for later."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_or_empty(column: str | Column = "text") -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit(""))


#: A column that the operators add for a while.
KEY = "_leafstack_key"


def row_key(ident: str | Column, text: str | Column) -> Column:
    """A hash of an id and a text: rows that repeat an id with another text are told apart by it."""
    return F.xxhash64(ident, text, F.isnull(ident))


#: Bits of the filter that is broadcast by ``inside`` and ``outside``: at most this many, in words of 64.
FILTER_BITS = 1 << 24


def _flagged(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """``df`` with _hit: false only if ``column`` is certainly not in ``ids``.

    The filter is a hash bitmap of at most ``FILTER_BITS`` / 64 rows however many ids there are; when it fills up it lets
    more rows through to the exact join, and nothing else changes.
    """
    bits = 1 << 16
    while bits < min(FILTER_BITS, 32 * ids.count()):
        bits *= 2
    place = lambda: F.pmod(F.xxhash64(column), F.lit(bits))
    words = ids.select(F.shiftright(place(), 6).alias("_leafstack_word"), F.lit(1).cast("long").alias("_leafstack_one"), (place() % 64).cast("int").alias("_leafstack_bit"))
    words = words.groupBy("_leafstack_word").agg(F.bit_or(F.call_function("shiftleft", F.col("_leafstack_one"), F.col("_leafstack_bit"))).alias("_leafstack_mask"))
    keyed = df.withColumn("_leafstack_at", place()).withColumn("_leafstack_word", F.shiftright("_leafstack_at", 6))
    bit = F.call_function("shiftrightunsigned", F.coalesce("_leafstack_mask", F.lit(0).cast("long")), (F.col("_leafstack_at") % 64).cast("int")).bitwiseAND(F.lit(1))
    return keyed.join(F.broadcast(words), "_leafstack_word", "left").withColumn("_leafstack_hit", F.col(column).isNotNull() & (bit == 1))


def inside(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` is in the written table ``ids``; only rows that the filter lets through are shuffled."""
    return _flagged(df, ids, column).where("_leafstack_hit").select(*df.columns).join(ids, column, "left_semi").select(*df.columns)


def outside(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` is null or not in the written table ``ids``; other rows are not shuffled."""
    flagged = _flagged(df, ids, column)
    doubtful = flagged.where("_leafstack_hit").select(*df.columns).join(ids, column, "left_anti").select(*df.columns)
    return flagged.where("NOT _leafstack_hit").select(*df.columns).unionByName(doubtful)


def one_of_repeated(df: DataFrame, repeated: DataFrame, key: str) -> DataFrame:
    """``df`` with one row for each ``key`` of the written table ``repeated``; other rows are not shuffled."""
    if repeated.isEmpty():
        return df
    others = [c for c in df.columns if c != key]
    one = inside(df, repeated, key).groupBy(key).agg(F.first(F.struct(*others)).alias("_leafstack_row")).select(key, "_leafstack_row.*")
    return outside(df, repeated, key).unionByName(one)
