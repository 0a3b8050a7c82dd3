"""Keeps the passages of a growing table of documents up to date.

    python -m jobs.passages --documents DIR --output DIR --checkpoint DIR [--config jobs/passages.json]

A file stream takes the Parquet files that came since the last run and stops. Of each micro-batch it writes

    documents/batch=N          a row for each document: where it came from, and whether its text can be trusted
    passages/batch=N/lang=L    the passages of those that can; the others wait for OCR

A micro-batch overwrites its own partitions, so one that is run again after a failure leaves the same rows once. A document
that comes again is a new version: ``passages`` reads, of each document, the batch that had it last, also where that version
has no passage left. Batches are numbered by the checkpoint, so output and checkpoint belong together.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafstack.functions.quality import page_quality
from leafstack.operators.chunking import chunks
from leafstack.sources.tables import read_or_empty, stream_path

log = logging.getLogger("passages")
CONFIG = Path(__file__).with_suffix(".json")

INPUT = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("text", "lang", "source"))])
DOCUMENT = "doc_id long, lang string, source string, chars int, needs_ocr boolean, batch long"
PASSAGE = "doc_id long, chunk_index int, text string, page_start int, page_end int, section string, batch long, lang string"


def _put(rows: DataFrame, path: str, *by: str) -> int:
    """Overwrite the partitions that ``rows`` have, and no others; the number of rows."""
    seen = Observation()
    counted = rows.observe(seen, F.count("*").alias("n"))
    counted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return seen.get["n"]


def _versions(batch: DataFrame) -> DataFrame:
    """doc_id, text, lang, source, quality: one row for each id."""
    version = F.max(F.struct(F.coalesce("text", F.lit("")).alias("text"), "lang", "source")).alias("v")
    found = batch.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(version).select("doc_id", "v.*")
    return found.withColumn("quality", page_quality(F.col("text")))


def add(batch: DataFrame, number: int, output: str, settings: dict) -> dict[str, int]:
    """Write one micro-batch: of rows that repeat an id the one with the greatest text; rows without an id have no place."""
    found, read = _versions(batch), Observation()
    pages = found.where("NOT quality.needs_ocr").select("doc_id", F.lit(1).alias("page"), "text")
    parts = chunks(pages, size=settings["chunk_size"], overlap=settings["chunk_overlap"])
    placed = parts.join(found.select("doc_id", "lang"), "doc_id").withColumn("batch", F.lit(number).cast("long"))
    n = {"passages": _put(placed, f"{output}/passages", "batch", "lang")}
    listed = _versions(batch.observe(read, F.count("*").alias("n"))).select("doc_id", "lang", "source", "quality.chars", "quality.needs_ocr", F.lit(number).cast("long").alias("batch"))
    n["documents"] = _put(listed, f"{output}/documents", "batch")  # last: passages count once their document is listed
    n["read"] = read.get["n"]
    log.info("batch %d: read %d rows, wrote %d documents and %d passages to %s", number, n["read"], n["documents"], n["passages"], output)
    return n


def update(spark: SparkSession, documents: str, output: str, checkpoint: str, settings: dict | None = None) -> dict[str, int]:
    """Take what is new at ``documents``, a folder, a pattern or a file; the numbers of batches, of rows read, and of documents and passages written."""
    settings = json.loads(CONFIG.read_text()) | (settings or {})
    total = {"batches": 0, "read": 0, "documents": 0, "passages": 0}

    def take(batch: DataFrame, number: int) -> None:
        for name, n in add(batch, number, output, settings).items():
            total[name] += n
        total["batches"] += 1

    stream = spark.readStream.schema(INPUT).option("maxFilesPerTrigger", settings["files_per_batch"]).parquet(stream_path(documents))
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %d new rows of %s in %d batches", total["read"], documents, total["batches"])
    return total


def _latest(spark: SparkSession, output: str) -> DataFrame:
    return read_or_empty(spark, f"{output}/documents", DOCUMENT).groupBy("doc_id").agg(F.max_by(F.struct("lang", "source", "chars", "needs_ocr"), "batch").alias("d"), F.max("batch").alias("batch"))


def documents(spark: SparkSession, output: str) -> DataFrame:
    """The last version of each document: doc_id, lang, source, chars, needs_ocr."""
    return _latest(spark, output).select("doc_id", "d.*")


def passages(spark: SparkSession, output: str) -> DataFrame:
    """The passages of the last version of each document."""
    rows = read_or_empty(spark, f"{output}/passages", PASSAGE)
    return rows.join(_latest(spark, output).select("doc_id", "batch"), ["doc_id", "batch"], "left_semi").select("doc_id", "lang", "chunk_index", "text", "page_start", "page_end", "section")


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("documents", "output", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", default=str(CONFIG))
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("passages").getOrCreate()
    try:
        update(spark, args.documents, args.output, args.checkpoint, json.loads(Path(args.config).read_text()))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
