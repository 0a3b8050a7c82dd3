"""Incremental ingest: new files of a landing folder, a micro-batch at a time, through the same path as a batch ingest."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafstack import schemas, scratch
from leafstack.plans.engine import Library
from leafstack.sources.files import identified, too_large
from leafstack.sources.store import not_ingested

log = logging.getLogger(__name__)


def watch(library: Library, landing: str, checkpoint: str, title: str, category: str = "general", language: str = "hi") -> StreamingQuery:
    """Ingest what is in ``landing`` now and stop.

    A file that is too large is refused: it is named in the log, and the others go on. A micro-batch is one change of the
    store under a name of its own, so one that is run again changes nothing.
    """

    def ingest(batch: DataFrame, number: int) -> None:
        # every action on a micro-batch reads all of its files whole, whatever columns it wants, so they are read once
        small = F.col("length") <= library.s.max_upload_bytes
        landed = scratch.written(identified(batch.withColumn("content", F.when(small, F.col("content")))), "landed")
        for f in too_large(landed, library.s).toLocalIterator():
            log.warning("refused, too large (%d bytes, at most %d): %s", f.length, library.s.max_upload_bytes, f.path)
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        library.ingest_files(not_ingested(landed.where(small), library.store.books()), title, category, language, tag=f"{stream}/{number}", read=landed)
        scratch.drop(landed)

    stream = library.spark.readStream.format("binaryFile").schema(schemas.SOURCE_FILE).load(landing)
    return stream.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
