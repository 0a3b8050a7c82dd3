from __future__ import annotations

import uuid
import zlib

import pytest
from pyspark.sql import functions as F

from leafstack.functions import text as tx
from leafstack.functions.quality import page_quality


def value(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("गुरु आए | शिष्य उठे || कथा शुरू", "गुरु आए । शिष्य उठे ॥ कथा शुरू"),
        ("a  \t b c", "a b c"),
        (" x \r\n y\r\n\r\n\r\n\r\nz ", "x\ny\n\nz"),
        ("été", "été"),
        ("दो । । तीन", "दो ॥ तीन"),
        ("a|b | c", "a|b । c"),
        ("", ""),
        (None, None),
    ],
)
def test_normal_form(spark, given, wanted):
    assert value(spark, given, tx.normalize(F.col("t"))) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("नमस्ते दुनिया", True), ("only latin here", False), ("नमस्ते and a long latin tail of words", False), ("123 !?", False), ("", False)])
def test_script(spark, given, wanted):
    assert value(spark, given, tx.is_devanagari(F.col("t"))) is wanted


def test_sentences(spark):
    out = value(spark, "यह पहला है। यह दूसरा ॥ Third one. fourth part. Fifth? Sixth! 3.5 kg", tx.split_sentences(F.col("t")))
    assert out == ["यह पहला है।", "यह दूसरा ॥", "Third one. fourth part.", "Fifth?", "Sixth!", "3.5 kg"]


def test_terms(spark):
    out = value(spark, "The Hanuman है चाँद ज़मीन a étoile x2 हनुमान", tx.tokenize(F.col("t")))
    assert out == ["hanuman", "चांद", "जमीन", "toile", "x2", "हनुमान"]
    assert value(spark, "हनुमान", tx.token_id(F.col("t"))) == zlib.crc32("हनुमान".encode()) & 0x7FFFFFFF


def test_labels_and_names(spark):
    row = spark.range(1).select(tx.page_label(F.lit(3), F.lit(3)), tx.page_label(F.lit(3), F.lit(5)), tx.safe_name(F.lit("a/b: ग्रंथ 1.pdf")), tx.excerpt(F.lit("x" * 701)), tx.excerpt(F.lit("x")), tx.contextual_text(F.lit("T"), F.lit("S"), F.lit("b")), tx.contextual_text(F.lit("T"), F.lit(""), F.lit("b"))).first()
    assert tuple(row) == ("p. 3", "pp. 3-5", "a_b_ ग्रंथ 1.pdf", "x" * 700 + "…", "x", "T | S\nb", "T\nb")


def test_point_ids_are_version_5_uuids(spark):
    space = uuid.UUID(tx.POINT_NAMESPACE)
    out = spark.range(50).select(tx.point_id(F.concat(F.lit("d"), "id"), F.col("id")).alias("p"), "id").collect()
    assert all(r.p == str(uuid.uuid5(space, f"d{r.id}:{r.id}")) for r in out)


def quality(spark, text):
    return value(spark, text, page_quality(F.col("t")))


def test_page_quality(spark):
    clean = "आज का दिन बहुत अच्छा है और हम सब लोग मिलकर किताब पढ़ रहे हैं क्योंकि यह ज़रूरी है।"
    assert not quality(spark, clean).needs_ocr
    assert quality(spark, "ािकताब ीपढ़ ोना " * 8).needs_ocr
    assert quality(spark, "क्ा " * 20).virama_matra == 20
    assert quality(spark, "").needs_ocr and quality(spark, "short").needs_ocr
    assert not quality(spark, "A page of plain English text that is long enough to judge by itself.").needs_ocr
    assert not quality(spark, "12345 67890 " * 10).needs_ocr
    assert quality(spark, "घर " * 100).needs_ocr
