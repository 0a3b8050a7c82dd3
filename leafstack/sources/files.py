"""Files to pages: text and Markdown, word-processor files, and PDF through a provider with OCR routing."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafstack import schemas
from leafstack.config import DEFAULTS, Settings
from leafstack.functions.quality import page_quality
from leafstack.functions.text import content_id, is_heading, normalize, strip
from leafstack.scratch import written

SUFFIXES = ("pdf", "docx", "txt", "md")


def files(spark: SparkSession, path: str, s: Settings = DEFAULTS) -> DataFrame:
    """path, doc_id, suffix, length, content of every file below ``path``.

    A file that is too large is an error at once, from the listing alone; a suffix that is not known is one when read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if large := too_large(raw, s).first():
        raise ValueError(f"file too large ({large.length} bytes, at most {s.max_upload_bytes}): {large.path}")
    return identified(raw)


def too_large(raw: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """path, length of the files that are refused; their content is not read."""
    return raw.select("path", "length").where(F.col("length") > s.max_upload_bytes)


def identified(raw: DataFrame) -> DataFrame:
    """``raw`` (path, length, content) with doc_id and suffix. A file without content, which was refused, may have any suffix."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./\\]+)\z", 1))
    known = F.when(suffix.isin(*SUFFIXES) | F.col("content").isNull(), suffix).otherwise(F.raise_error(F.concat(F.lit("unsupported file type: "), F.col("path"))))
    return raw.select("path", content_id(F.col("content")).alias("doc_id"), known.alias("suffix"), "length", "content")


def text_pages(found: DataFrame) -> DataFrame:
    """Pages of text files: parts between form feeds, numbered before blank ones are dropped."""
    parts = found.where(F.col("suffix").isin("txt", "md")).select("doc_id", F.posexplode(F.split(F.decode("content", "UTF-8"), "\f")).alias("at", "raw"))
    pages = parts.where(strip(F.col("raw")) != "").select("doc_id", (F.col("at") + 1).alias("page"), normalize(F.col("raw")).alias("text"))
    return pages.withColumn("ocr", F.lit(False))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def paragraphs(content: bytes) -> list[tuple[int, str, str, int, bool]]:
    """(number, text, style, page breaks, whether one was set by the layout) of each paragraph in the body of a DOCX file."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for style in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = style.find(f"{_W}name")
                names[style.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else ""
    out = []
    for k, p in enumerate(body.findall(f"{_W}p") if body is not None else []):
        text, laid_out, breaks = [], 0, 0
        for e in p.iter():
            if e.tag == f"{_W}t":
                text.append(e.text or "")
            elif e.tag == f"{_W}tab":
                text.append("\t")
            elif e.tag == f"{_W}lastRenderedPageBreak":
                laid_out += 1
            elif e.tag == f"{_W}br":
                if e.get(f"{_W}type") == "page":
                    breaks += 1
                else:
                    text.append("\n")
        style = p.find(f"{_W}pPr/{_W}pStyle")
        ident = style.get(f"{_W}val") if style is not None else "Normal"
        out.append((k, "".join(text), names.get(ident, ident), breaks + laid_out, laid_out > 0))
    return out


def docx_paragraphs(found: DataFrame) -> DataFrame:
    """doc_id, para int, text, style, breaks int, laid_out boolean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, content in zip(b.column("doc_id").to_pylist(), b.column("content")):
                rows = paragraphs(content.as_py())
                columns = list(zip(*rows)) or [[]] * 5
                types = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(rows), pa.string()), *(pa.array(c, t) for c, t in zip(columns, types))], names=["doc_id", "para", "text", "style", "breaks", "laid_out"])

    return found.where("suffix = 'docx'").select("doc_id", "content").mapInArrow(run, "doc_id string, para int, text string, style string, breaks int, laid_out boolean")


def docx_pages(paras: DataFrame) -> DataFrame:
    """Pages of word-processor files.

    A break that the layout put into a paragraph with text counts before it, other breaks after it. Headings that follow
    each other are one, on the first one's page.
    """
    order = Window.partitionBy("doc_id").orderBy("para")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    bare = strip(F.col("text"))
    placed = paras.withColumn("bare", bare).withColumn("early", F.when((F.col("bare") != "") & F.col("laid_out"), F.col("breaks")).otherwise(0))
    placed = placed.withColumn("page", (1 + F.coalesce(F.sum("breaks").over(before), F.lit(0)) + F.col("early")).cast("int")).where("bare <> ''")
    placed = placed.withColumn("heading", is_heading(F.col("bare"), F.col("style")))
    # a run of headings is an island: paragraphs that are not headings number it
    placed = placed.withColumn("island", F.sum((~F.col("heading")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para", "bare"))), lambda x: x.bare), " — ")
    heads = placed.where("heading").groupBy("doc_id", "island").agg(F.min("para").alias("para"), F.min("page").alias("page"), F.concat(F.lit("## "), run).alias("bare"))
    together = heads.select("doc_id", "page", "para", "bare").unionByName(placed.where("NOT heading").select("doc_id", "page", "para", "bare"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para", "bare"))), lambda x: x.bare), "\n\n")
    return together.groupBy("doc_id", "page").agg(joined.alias("text")).select("doc_id", "page", normalize(F.col("text")).alias("text"), F.lit(False).alias("ocr"))


def ocr_routing(pages: DataFrame, doc: str = "doc_id", mode: str = "auto", share: float = DEFAULTS.ocr_share, text: str = "text") -> DataFrame:
    """``pages`` with needs_ocr and to_ocr: all pages, none, or the flagged ones (all of a document with more than ``share`` flagged)."""
    if mode not in ("always", "never", "auto"):
        raise ValueError(f"unknown OCR mode: {mode}")
    flagged = pages.withColumn("needs_ocr", page_quality(F.col(text)).needs_ocr)
    if mode != "auto":
        return flagged.withColumn("to_ocr", F.lit(mode == "always"))
    rates = flagged.groupBy(doc).agg(F.avg(F.col("needs_ocr").cast("int")).alias("_rate"))
    return flagged.join(rates, doc).withColumn("to_ocr", F.col("needs_ocr") | (F.col("_rate") > share)).drop("_rate")


def ocr_missing(pages: DataFrame, memo: DataFrame, provider, model: str) -> DataFrame:
    """Rows for the memo (doc_id, model, page, text): the pages (doc_id, page, image, to_ocr) that it lacks, read by ``provider``."""
    known = memo.where(F.col("model") == model).select("doc_id", "page")
    asked = pages.where("to_ocr").join(known, ["doc_id", "page"], "left_anti")
    return provider.read(asked.select("doc_id", "page", "image")).select("doc_id", F.lit(model).alias("model"), "page", "text")


def with_ocr(pages: DataFrame, memo: DataFrame, model: str) -> DataFrame:
    """Pages (doc_id, page, text, to_ocr) with the memo's text where OCR is asked for; blank ones are dropped."""
    known = memo.where(F.col("model") == model).select("doc_id", "page", F.col("text").alias("memo_text"))
    joined = pages.join(known, ["doc_id", "page"], "left")
    text = F.when(F.col("to_ocr"), F.coalesce("memo_text", "text")).otherwise(F.col("text"))
    return joined.select("doc_id", "page", normalize(text).alias("text"), F.col("to_ocr").alias("ocr")).where(strip(F.col("text")) != "")


def read_with_ocr(pages: DataFrame, memo: DataFrame, provider, model: str) -> tuple[DataFrame, DataFrame]:
    """Pages with OCR text where it is asked for, and the rows to add to the memo. Only pages that it lacks reach the provider."""
    fresh = ocr_missing(pages, memo, provider, model)
    return with_ocr(pages, memo.select("doc_id", "model", "page", "text").unionByName(fresh), model), fresh


def load_pages(found: DataFrame, pdf=None, ocr=None, store=None, s: Settings = DEFAULTS) -> DataFrame:
    """Pages of all files. ``pdf`` is a provider whose ``pages(files)`` gives (doc_id, page, text, image); without one a PDF is an error.

    With an OCR provider ``ocr`` and a ``store`` for its memo, pages whose text layer cannot be trusted are read by it, as
    ``ocr_mode`` says. The layer is staged, so files are opened once, and what was read is remembered before it is used.
    """
    out = text_pages(found).unionByName(docx_pages(docx_paragraphs(found))).select(*schemas.PAGE.names)
    rest = found.where("suffix = 'pdf'")
    if pdf is None:
        refused = rest.select("doc_id", F.raise_error(F.concat(F.lit("no PDF provider for "), F.col("path"))).cast("int").alias("page"), F.lit("").alias("text"), F.lit(False).alias("ocr"))
        return out.unionByName(refused)
    if ocr is None:
        if s.ocr_mode == "always":
            raise ValueError("OCR of all pages needs a provider")
        layer = pdf.pages(rest).select("doc_id", "page", normalize(F.col("text")).alias("text"), F.lit(False).alias("ocr"))
        return out.unionByName(layer.where(strip(F.col("text")) != ""))
    layer = written(pdf.pages(rest).select("doc_id", "page", "text", "image"), "layer")
    routed = ocr_routing(layer, mode=s.ocr_mode, share=s.ocr_share)
    store.remember_ocr(ocr_missing(routed, store.ocr_cache(), ocr, s.ocr_model))
    return out.unionByName(with_ocr(routed, store.ocr_cache(), s.ocr_model))
