"""Row types. They are fixed; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "binary": T.BinaryType(),
    "array<float>": T.ArrayType(T.FloatType()),
    "array<tinyint>": T.ArrayType(T.ByteType()),
}


def _of(fields: str) -> T.StructType:
    """From ``name type, ...``, without a session, since workers import this too."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in fields.split(","))])


SOURCE_FILE = _of("path string, modificationTime timestamp, length long, content binary")
PAGE = _of("doc_id string, page int, text string, ocr boolean")
PAGE_QUALITY = _of("chars int, orphan_ratio double, virama_matra int, i_matra_ratio double, needs_ocr boolean")
CHUNK = _of("doc_id string, chunk_index int, text string, page_start int, page_end int, section string")
POINT = _of(
    "point_id string, doc_id string, title string, category string, language string, chunk_index int, section string, "
    "page_start int, page_end int, text string, dense array<float>, codes array<tinyint>"
)
POSTING = _of("point_id string, doc_id string, token_id long, weight double")
BOOK = _of(
    "doc_id string, title string, category string, language string, source_file string, pages int, chunks int, ocr_pages int, ingested_at string"
)
MESSAGE = _of("role string, content string")
OCR_CACHE = _of("doc_id string, model string, page int, text string")
JOB = _of("job_id string, status string, stage string, done int, total int, error string, doc_id string")
