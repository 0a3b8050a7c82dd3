"""The sliding-window limiter as keyed state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "client long, hit long, at timestamp, admitted boolean, retry_after int"


class Limiter(StatefulProcessor):
    """Keeps the times of a client's admitted hits in the window; hits of one batch are taken in order of time and id."""

    def __init__(self, limit: int, seconds: float):
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", T.StructType([T.StructField("at", T.DoubleType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        hits = pd.concat(list(rows)).sort_values(["at", "hit"])
        recent, out = [r[0] for r in self.recent.get()], []
        for hit, at, now in zip(hits["hit"], hits["at"], hits["second"]):
            recent = [t for t in recent if t >= now - self.seconds]
            free = self.limit <= 0 or len(recent) < self.limit
            out.append((key[0], hit, at, free, None if free else int(self.seconds - (now - recent[0])) + 1))
            if free and self.limit > 0:
                recent.append(now)
        self.recent.put([(t,) for t in recent]) if recent else self.recent.clear()
        yield pd.DataFrame(out, columns=["client", "hit", "at", "admitted", "retry_after"]).astype({"retry_after": "Int32"})

    def close(self) -> None:
        pass


def limited(hits: DataFrame, limit: int, seconds: float) -> DataFrame:
    """Decisions on a stream of hits (client long, hit long, at timestamp). Needs the RocksDB state store provider.

    A client's hits of one micro-batch are sorted by one task in memory: bound them by the stream's files or offsets a batch.
    Times are told apart as seconds since 1970, whatever the session's time zone does in between.
    """
    seconds_of = F.col("at").cast("timestamp").cast("double")
    return hits.select("client", "hit", "at", seconds_of.alias("second")).groupBy("client").transformWithStateInPandas(
        statefulProcessor=Limiter(limit, seconds), outputStructType=OUTPUT, outputMode="append", timeMode="none"
    )
