"""Pages into section-aware, overlapping chunks with the pages they came from.

Paragraphs and sections are expressions and one window. The packing of sentences depends on where the last chunk
ended; it reads the window's rows in order, as a stream in Arrow batches, and holds the sentences of one chunk, so a document
takes no memory however long it is. Window and packing share one shuffle by document.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafstack.config import DEFAULTS, Settings
from leafstack.functions.text import sentences, strip
from leafstack.schemas import CHUNK


def sections(pages: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """Body paragraphs: doc, section_no int (0 before any heading), section string, page, para int, body string.

    A paragraph that starts with ``#`` opens a section named by its first line of words; its further lines are body.
    A section goes on over pages; one without body has no row. Line breaks inside a paragraph are layout, except in verse.
    """
    paras = pages.select(doc, page, F.posexplode(F.split(text, "\n\n")).alias("para", "raw")).withColumn("raw", strip(F.col("raw"))).where("raw <> ''")
    heading = F.col("raw").startswith("#")
    name = F.split(strip(F.regexp_replace("raw", r"\A#+", "")), "\n", 2)[0]
    rest = F.when(F.instr("raw", "\n") > 0, strip(F.regexp_replace("raw", r"(?s)\A[^\n]*\n", ""))).otherwise("")
    so_far = Window.partitionBy(doc).orderBy(page, "para").rowsBetween(Window.unboundedPreceding, 0)
    named = paras.select(
        doc,
        F.sum(heading.cast("int")).over(so_far).cast("int").alias("section_no"),
        F.coalesce(F.last(F.when(heading, name), ignorenulls=True).over(so_far), F.lit("")).alias("section"),
        page,
        "para",
        F.when(heading, rest).otherwise(F.col("raw")).alias("body"),
    )
    unwrapped = F.when(F.instr("body", "॥") > 0, F.col("body")).otherwise(F.replace("body", F.lit("\n"), F.lit(" ")))
    return named.where("body <> ''").withColumn("body", unwrapped)


def wrapped(sentence: str, size: int) -> list[str]:
    """Runs of words of at most ``size`` characters; a longer word stays whole."""
    words = sentence.split()
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    out, start = [], 0
    while start < len(words):
        stop = max(start + 1, bisect_right(ends, ends[start] + size + 1) - 1)
        out.append(" ".join(words[start:stop]))
        start = stop
    return out


class Packer:
    """Sentences of one section, one by one, into chunks.

    A chunk takes as many as fit in ``size`` with a blank after each (at least one); the next one goes back by what fits in
    ``overlap``, but starts at least one sentence later.
    """

    def __init__(self, size: int, overlap: int):
        self.size, self.overlap, self.held, self.chars = size, overlap, deque(), 0

    def add(self, sentence: str, page: int) -> Iterator[tuple[str, int, int]]:
        """(text, first page, last page) of the chunks that end before this sentence."""
        while self.held and self.chars + len(sentence) + 1 > self.size:
            yield self._chunk()
            self._drop()
            while self.chars > self.overlap + 1:
                self._drop()
        self.held.append((sentence, page))
        self.chars += len(sentence) + 1

    def end(self) -> Iterator[tuple[str, int, int]]:
        """The last chunk of the section."""
        if self.held:
            yield self._chunk()
            self.held.clear()
            self.chars = 0

    def _drop(self) -> None:
        self.chars -= len(self.held.popleft()[0]) + 1

    def _chunk(self) -> tuple[str, int, int]:
        return " ".join(s for s, _ in self.held), self.held[0][1], self.held[-1][1]


def chunks(pages: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text", size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap, wrap: bool = True) -> DataFrame:
    """doc, chunk_index int, text, page_start int, page_end int, section; a document without sentences has no row.

    A sentence longer than ``size`` is cut between words; without ``wrap`` it stays whole, as a chunk of its own.
    """
    rows = sections(pages, doc, page, text).select(doc, "section_no", "section", F.col(page).cast("int").alias("page"), "para", "body")
    kind = rows.schema[doc].dataType.simpleString()
    names = [doc, *CHUNK.names[1:]]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, now, number, out, types = Packer(size, overlap), None, 0, [], None

        def take(found: Iterator[tuple[str, int, int]]) -> None:
            nonlocal number
            for chunk, first, last in found:
                out.append((now[0], number, chunk, first, last, now[2]))
                number += 1

        def table() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for b in batches:
            types = [b.schema.field(doc).type, pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            columns = (b.column(c).to_pylist() for c in (doc, "section_no", "section", "page"))
            for ident, part, title, at, body in zip(*columns, b.column("body")):
                if now is None or (ident, part) != now[:2]:
                    take(packer.end())
                    number = number if now is not None and ident == now[0] else 0
                    now = (ident, part, title)
                for whole in sentences(body.as_py()):
                    for s in wrapped(whole, size) if wrap and len(whole) > size else [whole]:
                        take(packer.add(s, at))
                if len(out) >= 1024:
                    yield table()
        if now is not None:
            take(packer.end())
            yield table()

    # the window has dealt out the documents and put their rows in this order; sections follow it
    ordered = rows.sortWithinPartitions(doc, "page", "para").drop("para")
    return ordered.mapInArrow(pack, f"`{doc}` {kind}, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CHUNK.fields[1:]))


def index_texts(found: DataFrame, title: Column, s: Settings = DEFAULTS) -> DataFrame:
    """``found`` with what is embedded of each chunk and what is indexed of it."""
    from leafstack.functions.text import contextual_text, sparse_text

    return found.withColumn("embed_text", contextual_text(title, F.col("section"), F.col("text"))).withColumn("index_text", sparse_text(F.col("section"), F.col("text")))
