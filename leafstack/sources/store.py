"""Parquet tables of an ingested library: chunks, postings, catalogue, page audit and OCR memo.

A change only adds. Its rows go to partitions of their own, ``batch=<id>`` of each table; ``members`` lists the documents it
replaces, with or without new rows; a row in ``batches``, written last, makes all of it visible at once. A change that fails
before that leaves nothing to be seen. So a change costs what it brings, and a deletion one row a document. Of each document
the rows of its last batch count; changes of several writers are all kept, and one order decides for every reader which of
two versions of a document is the last.

A posting is stored with its document and the number of its chunk, which name the point; names of 36 characters that nothing
repeats were nearly all of its bytes. Postings that come with a point and no chunk keep it.

Inside a batch, rows are dealt to folders: postings by term and everything else by document, as many as the batch's size
needs, so a question opens the folders of its terms, and a look-up those of its documents. Batches of one size class are
merged when there are ``MERGE`` of them; what they were merged from is deleted with the next merge.
"""

from __future__ import annotations

import hashlib
import threading
import uuid
from collections import defaultdict
from collections.abc import Iterable
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafstack import schemas, scratch
from leafstack.functions.text import point_id
from leafstack.sources.tables import read_or_empty

TABLES: dict[str, T.StructType] = {"chunks": schemas.POINT, "postings": schemas.POSTING, "pages": schemas.PAGE, "catalogue": schemas.BOOK}
#: As they are in files.
STORED: dict[str, T.StructType] = TABLES | {"postings": T.StructType([*schemas.POSTING.fields, schemas.CHUNK["chunk_index"]])}
BATCH = "batch string, seq long, folders int, chunks long, tag string, merged array<string>"
#: whole: all rows of the document are replaced; else its catalogue row alone. seq and origin, the batch that the change came
#: with, are its place in the order of changes, also in a merged batch.
MEMBER = "doc_id string, seq long, origin string, chunks long, whole boolean, batch string"
#: Chunks that share a folder, and the most folders of a batch.
FOLDER, FOLDERS = 5_000, 4_096
#: Batches of one size class that are merged; a class holds batches up to ``MERGE`` times the size of the one below.
MERGE = 8


def upsert(existing: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """``existing`` with the rows of ``new`` in place of those with their key; of repeated new keys the last by ``order``."""
    if order:
        rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
        new = new.withColumn("_r", rank).where("_r = 1").drop("_r")
    else:
        new = new.dropDuplicates([key])
    return existing.join(new.select(key), key, "left_anti").select(*existing.columns).unionByName(new.select(*existing.columns))


def without(existing: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return existing.join(gone.select(key).distinct(), key, "left_anti").select(*existing.columns)


def not_ingested(files: DataFrame, catalogue: DataFrame, key: str = "doc_id", force: bool = False) -> DataFrame:
    """Files whose content the catalogue does not have; all of them if forced."""
    return files if force else files.join(catalogue.select(key), key, "left_anti")


def by_title(books: DataFrame) -> DataFrame:
    """The catalogue's listing order; equal titles by id."""
    return books.orderBy("title", "doc_id")


def number_of(doc_id: str) -> int:
    """What deals a document to a folder, modulo the number of folders."""
    return int(hashlib.sha256(doc_id.encode()).hexdigest()[:8], 16)


def number_column(doc_id: Column) -> Column:
    """The same as an expression."""
    return F.conv(F.substring(F.sha2(F.encode(doc_id, "UTF-8"), 256), 1, 8), 16, 10).cast("long")


def size_class(chunks: int) -> int:
    return int(log(max(chunks, 1), MERGE))


class Store:
    """The tables under ``root``, on any file system that the session reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._lock = spark, root.rstrip("/"), threading.RLock()

    # ------------------------------------------------------------ what is there

    def version(self) -> tuple[str, ...]:
        """Names the state of the store; another change, another version. No job runs."""
        return tuple(sorted(self._batches().inputFiles()))

    def _batches(self) -> DataFrame:
        return read_or_empty(self.spark, f"{self.root}/batches", BATCH)

    def batches(self) -> list[Row]:
        """The batches that count, a few rows: those that are not part of a merged one."""
        rows = self._batches().collect()
        merged = {b for r in rows for b in r.merged}
        return sorted((r for r in rows if r.batch not in merged), key=lambda r: (r.seq, r.batch))

    def _members(self, batches: list[Row]) -> DataFrame:
        return read_or_empty(self.spark, f"{self.root}/members", MEMBER).where(F.col("batch").isin([b.batch for b in batches]))

    def _last(self, batches: list[Row], whole: bool) -> DataFrame:
        """doc_id, last (seq, origin, chunks, batch): the last change of each document; with ``whole`` of those of all its rows."""
        members = self._members(batches)
        return (members.where("whole") if whole else members).groupBy("doc_id").agg(F.max(F.struct("seq", "origin", "chunks", "batch")).alias("last"))

    def _old(self, batches: list[Row], whole: bool) -> DataFrame:
        """doc_id, batch of the rows that no longer count: few, as merges drop them."""
        members = self._members(batches)
        rows = members.where("whole") if whole else members
        return rows.join(self._last(batches, whole), "doc_id").where("batch <> last.batch").select("doc_id", "batch").distinct()

    def _rows(self, name: str, batches: list[Row], numbers: Iterable[int] | None = None) -> DataFrame:
        """The stored rows of a table that count, with their batch; of the folders that ``numbers`` are dealt to, if given."""
        schema = T.StructType([*STORED[name].fields, T.StructField("batch", T.StringType()), T.StructField("folder", T.IntegerType())])
        rows = read_or_empty(self.spark, f"{self.root}/{name}", schema)
        by_count: dict[int, list[str]] = defaultdict(list)
        for b in batches:
            by_count[b.folders].append(b.batch)
        wanted = [F.col("batch").isin(own) & (F.col("folder").isin(sorted({n % k for n in numbers})) if numbers is not None else F.lit(True)) for k, own in by_count.items()]
        rows = rows.where(reduce(Column.__or__, wanted) if wanted else F.lit(False))
        return rows.join(self._old(batches, name != "catalogue"), ["doc_id", "batch"], "left_anti") if len(batches) > 1 else rows

    # ------------------------------------------------------------ tables

    def _named(self, name: str, numbers: Iterable[int] | None = None) -> DataFrame:
        """The rows of a table that count, with the columns it has for readers."""
        rows = self._rows(name, self.batches(), numbers)
        if name == "postings":
            rows = rows.withColumn("point_id", F.coalesce("point_id", point_id(F.col("doc_id"), F.col("chunk_index"))))
        return rows.select(*TABLES[name].names)

    def table(self, name: str, doc_ids: list[str] | None = None) -> DataFrame:
        """A table, empty if nothing was written yet; with ``doc_ids`` their rows, from their folders only."""
        if not doc_ids:
            return self._named(name)
        numbers = None if name == "postings" else [number_of(d) for d in doc_ids]
        return self._named(name, numbers).where(F.col("doc_id").isin(*doc_ids))

    def chunks(self, doc_ids: list[str] | None = None) -> DataFrame:
        return self.table("chunks", doc_ids)

    def postings(self, token_ids: list[int] | None = None) -> DataFrame:
        """Postings, all or those of some terms, from the terms' folders only."""
        if token_ids is None:
            return self.table("postings")
        return self._named("postings", token_ids).where(F.col("token_id").isin(*token_ids) if token_ids else F.lit(False))

    def count(self) -> int:
        """The number of chunks, from what the members say."""
        return self._last(self.batches(), True).agg(F.sum("last.chunks")).first()[0] or 0

    # ------------------------------------------------------------ changes

    def replace(self, ids: DataFrame, tables: dict[str, DataFrame], tag: str | None = None) -> bool:
        """Put ``tables`` in place of all rows of the documents ``ids`` (doc_id); tables that are not named lose their rows too.

        A change with a ``tag`` that some batch has is not made again; whether it was made.
        """
        ids = scratch.written(ids.select("doc_id").distinct(), "ids")
        return self._change(ids, tables, True, tag)

    def delete_documents(self, gone: DataFrame) -> None:
        """Remove every row of the documents ``gone`` (doc_id) from all tables."""
        self.replace(gone, {})

    def put_books(self, rows: DataFrame) -> None:
        """Insert or replace catalogue rows; the documents' other tables stay."""
        rows = scratch.written(rows.select(*schemas.BOOK.names).dropDuplicates(["doc_id"]), "books")
        self._change(rows.select("doc_id"), {"catalogue": rows}, False, None)

    def _change(self, ids: DataFrame, tables: dict[str, DataFrame], whole: bool, tag: str | None) -> bool:
        with self._lock:
            before = self._batches()
            if tag is not None and not before.where(F.col("tag") == tag).isEmpty():
                return False
            seq = 1 + (before.agg(F.max("seq")).first()[0] or 0)
            kept = {name: rows.select(*(n for n in STORED[name].names if n in rows.columns)).join(ids, "doc_id", "left_semi") for name, rows in tables.items()}
            counts = kept["chunks"].groupBy("doc_id").agg(F.count("*").alias("chunks")) if "chunks" in kept else ids.select("doc_id", F.lit(0).cast("long").alias("chunks")).limit(0)
            members = ids.join(counts, "doc_id", "left").select("doc_id", F.lit(seq).cast("long").alias("seq"), F.lit(None).cast("string").alias("origin"), F.coalesce("chunks", F.lit(0).cast("long")).alias("chunks"), F.lit(whole).alias("whole"))
            self._add(members, kept, seq, tag, [])
            scratch.drop(ids)
            self._merge()
            return True

    def _add(self, members: DataFrame, tables: dict[str, DataFrame], seq: int, tag: str | None, merged: list[str]) -> None:
        """A new batch; its row in ``batches`` comes last."""
        batch = uuid.uuid4().hex
        members.withColumn("origin", F.coalesce("origin", F.lit(batch))).write.parquet(f"{self.root}/members/batch={batch}")
        n, chunks = self.spark.read.parquet(f"{self.root}/members/batch={batch}").agg(F.count("*"), F.sum("chunks")).first()
        folders = min(FOLDERS, 1 + max(n, chunks or 0) // FOLDER)
        for name, rows in tables.items():
            number, order = (F.col("token_id"), "token_id") if name == "postings" else (number_column(F.col("doc_id")), "doc_id")
            dealt = rows.withColumn("folder", (number % folders).cast("int")).repartitionById(folders, F.col("folder"))  # a task a folder
            with scratch.freed(rows.sparkSession):
                dealt.sortWithinPartitions("folder", order).write.option("compression", "zstd").partitionBy("folder").parquet(f"{self.root}/{name}/batch={batch}")
        row = (batch, seq, folders, chunks or 0, tag, merged)
        self.spark.createDataFrame([row], BATCH).coalesce(1).write.mode("append").parquet(f"{self.root}/batches")

    def _merge(self) -> None:
        """Merge the batches of a size class that has ``MERGE`` of them; a row is written again once for each class it passes."""
        classes: dict[int, list[Row]] = defaultdict(list)
        batches = self.batches()
        for b in batches:
            classes[size_class(b.chunks)].append(b)
        for own in classes.values():
            if len(own) >= MERGE:
                self._forget([b for r in self._batches().collect() for b in r.merged])
                self.merge(own)

    def merge(self, own: list[Row]) -> None:
        """Write the batches ``own`` as one, without the rows that later ones of them replace.

        Members keep their place in the order of changes, so batches need not follow each other. Those of deleted documents
        stay as well: an older version may be in another batch.
        """
        last = self._members(own).groupBy("doc_id", "whole").agg(F.max(F.struct("seq", "origin", "chunks")).alias("m"))
        members = last.select("doc_id", "m.seq", "m.origin", "m.chunks", "whole")
        tables = {name: self._rows(name, own).select(*STORED[name].names) for name in TABLES}
        self._add(members, tables, max(b.seq for b in own), None, [b.batch for b in own])

    def compact(self) -> None:
        """Merge everything, so that no replaced row is stored any more."""
        with self._lock:
            self.merge(self.batches())

    # ------------------------------------------------------------ files

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _forget(self, batches: list[str]) -> None:
        """Delete the files of batches that are part of a merged one."""
        for batch in batches:
            for name in ("members", *TABLES):
                fs, p = self._fs(f"{self.root}/{name}/batch={batch}")
                fs.delete(p, True)

    # ------------------------------------------------------------ OCR memo

    def ocr_cache(self) -> DataFrame:
        return read_or_empty(self.spark, f"{self.root}/ocr_cache", schemas.OCR_CACHE)

    def remember_ocr(self, rows: DataFrame) -> None:
        rows.select(*schemas.OCR_CACHE.names).write.mode("append").parquet(f"{self.root}/ocr_cache")

    # ------------------------------------------------------------ catalogue

    def books(self) -> DataFrame:
        return by_title(self.table("catalogue"))

    def book(self, doc_id: str):
        return self.table("catalogue", [doc_id]).first()

    def remove_book(self, doc_id: str) -> bool:
        """Remove a document and its catalogue row; whether it was there."""
        with self._lock:
            there = self.book(doc_id) is not None
            if there:
                self.delete_documents(self.spark.createDataFrame([(doc_id,)], "doc_id string"))
            return there


def catalogue_rows(pages: DataFrame, chunks: DataFrame, books: DataFrame, ingested_at: str) -> DataFrame:
    """Catalogue rows: ``books`` (doc_id, title, category, language, source_file) with counts of pages, chunks and OCR pages."""
    p = pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("pages"), F.sum(F.col("ocr").cast("int")).cast("int").alias("ocr_pages"))
    c = chunks.groupBy("doc_id").agg(F.count("*").cast("int").alias("chunks"))
    filled = books.join(p, "doc_id", "left").join(c, "doc_id", "left").fillna(0, ["pages", "chunks", "ocr_pages"])
    return filled.withColumn("ingested_at", F.lit(ingested_at)).select(*schemas.BOOK.names)
