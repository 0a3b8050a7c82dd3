"""The sliding-window limiter as a fold over each client's hits.

A hit is admitted if fewer than ``limit`` admitted hits lie in the last ``seconds``; rejected hits are not counted. That
depends on earlier decisions, so it is a fold and not a range window. But a hit that comes more than ``seconds`` after the
one before depends on nothing, so a client's hits are cut there, and every stretch between such gaps is folded by itself.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from math import floor

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def decisions(hits: DataFrame, client: str, at: str, tie: str, limit: int, seconds: float) -> DataFrame:
    """client, ``tie``, at, admitted boolean, retry_after int (seconds, null if admitted).

    ``tie`` orders hits of one instant. A limit of 0 or less admits everything. Hits are sorted by client, stretch and time
    and read as a stream that keeps the times of the last ``limit`` admitted hits, so a stretch with any number of hits takes
    no memory. A client's stretches go to many tasks; decisions inside one follow from one another and are one task's work.
    """
    second = F.col(at).cast("timestamp").cast("double") if dict(hits.dtypes)[at].startswith("timestamp") else F.col(at).cast("double")
    rows = hits.select(client, F.col(tie), F.col(at), second.alias("_s"))
    if limit <= 0:
        return rows.select(client, tie, at, F.lit(True).alias("admitted"), F.lit(None).cast("int").alias("retry_after"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, recent = object(), deque()
        for b in batches:
            admitted, wait = [], []
            for who, s in zip(zip(b.column(client).to_pylist(), b.column("_start").to_pylist()), b.column("_s").to_pylist()):
                if who != now:  # another client or stretch
                    now, recent = who, deque()
                while recent and recent[0] < s - seconds:
                    recent.popleft()
                admitted.append(len(recent) < limit)
                wait.append(None if admitted[-1] else floor(seconds - (s - recent[0])) + 1)
                if admitted[-1]:
                    recent.append(s)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (client, tie, at)), pa.array(admitted, pa.bool_()), pa.array(wait, pa.int32())], names=[client, tie, at, "admitted", "retry_after"])

    schema = T.StructType([*(rows.schema[c] for c in (client, tie, at)), T.StructField("admitted", T.BooleanType()), T.StructField("retry_after", T.IntegerType())])
    return with_stretches(rows, client, tie, seconds).repartition(client, "_start").sortWithinPartitions(client, "_start", "_s", tie).mapInArrow(fold, schema)


#: Hits of a client in so many times ``seconds`` are looked at together to find the gaps.
SPAN = 16


def with_stretches(rows: DataFrame, client: str, tie: str, seconds: float) -> DataFrame:
    """``rows`` (client, tie, _s, ...) with _start double: the time of the first hit of the stretch that a hit belongs to.

    Gaps are found among the hits of a client in a span of time. What a span takes over from the one before it follows from
    a row for each span, of which a client has as many as the table's time allows, whatever its number of hits.
    """
    spanned = rows.withColumn("_b", F.floor(F.col("_s") / (SPAN * seconds)))
    inside = Window.partitionBy(client, "_b").orderBy("_s", tie)
    spanned = spanned.withColumn("_cut", F.when(F.col("_s") - F.lag("_s").over(inside) > seconds, F.col("_s")))
    spans = spanned.groupBy(client, "_b").agg(F.min("_s").alias("first"), F.max("_s").alias("last"), F.max("_cut").alias("cut"))
    order = Window.partitionBy(client).orderBy("_b")
    new = F.coalesce(F.col("first") - F.lag("last").over(order) > seconds, F.lit(True))
    spans = spans.withColumn("new", new).withColumn("open", F.coalesce("cut", F.when(F.col("new"), F.col("first"))))
    before = F.last("open", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select(F.col(client).alias("_client"), F.col("_b").alias("_at"), F.when(F.col("new"), F.col("first")).otherwise(before).alias("_head"))
    placed = spanned.join(spans, F.col(client).eqNullSafe(F.col("_client")) & (F.col("_b") == F.col("_at")))
    start = F.coalesce(F.max("_cut").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "_head")
    return placed.withColumn("_start", start).select(*rows.columns, "_start")
