"""Text expressions for Devanagari and Latin scripts: normal form, script test, sentences, terms, labels."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from unicodedata import is_normalized
from unicodedata import normalize as compose

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words of Hindi, Sanskrit and English that are not indexed.
STOPWORDS = tuple(
    """
    है हैं था थी थे हो होता होती होते का के की को में से पर ने और भी तो यह वह ये वे इस उस इन उन एक
    कि कर करके किया दिया जो जा जब तब तक लिए लिये ही नहीं न कुछ क्या क्यों कैसे अपने अपना अपनी मैं
    हम तुम आप उसे उसने उनके उनकी उनका सब बहुत अब फिर साथ बाद रहा रही रहे गया गई गए
    च वा हि तु एव अपि इति स सा तत् ते
    a an the of to in on for and or is are was were be been it this that with as by at from
    what who whom which why how do does did i you he she we they me my your his her our their
    """.split()
)

# The characters and boundaries the expressions below speak of.
WHITE = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
DEVANAGARI = r"ऀ-ॿ"
TERM = r"[a-z0-9]+|[ऀ-ॣ०-ॿ]+"
# White space of a regular expression, which knows no separators of fields.
GAP = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SENTENCE_END = rf"(?U)(?<=[।॥?!])\s+|(?<=[.])\s+(?=[A-Z{DEVANAGARI}\"“'])"
NUKTA, CHANDRABINDU, ANUSVARA = "़", "ँ", "ं"


@functools.cache
def _nfc_udf():
    def run(text: pa.Array) -> pa.Array:
        return pa.array([s if s is None or s.isascii() or is_normalized("NFC", s) else compose("NFC", s) for s in text.to_pylist()], pa.string())

    run.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")


def nfc(text: Column) -> Column:
    """Unicode composition; Spark has no expression for it.

    Nothing below U+0300 can be composed with anything, so only texts with a character from there on cross to Arrow batches.
    """
    return F.coalesce(_nfc_udf()(F.when(text.rlike(r"[^\x{0}-\x{2FF}]"), text)), text)


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.btrim(text, F.lit(WHITE))


def normalize(text: Column) -> Column:
    """Composed text with dandas for pipes, single blanks, stripped lines and no more than one empty line in a row."""
    return _normal_udf()(text)


@functools.cache
def _normal_udf():
    def run(text: pa.Array) -> pa.Array:
        return pa.array([s if s is None else normal_form(s) for s in text.to_pylist()], pa.string())

    run.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")


# The replacements and their order.
_PIPES = ((re.compile(rf"(?<=[{DEVANAGARI}]|{GAP})\|\|(?={GAP}|\Z)"), "॥"), (re.compile(rf"(?<=[{DEVANAGARI}]|{GAP})\|(?={GAP}|\Z)"), "।"))
_DANDAS = re.compile(rf"।{GAP}*।")
_BLANKS = re.compile("[ \t\xa0\u200b]+")
_EMPTY_LINES = re.compile("\n{3,}")


def normal_form(text: str) -> str:
    """``normalize`` of one text. Composition has to run in Python; the rest of it, with plain string methods, takes an eighth
    of what regular expressions over the column take."""
    out = text if text.isascii() or is_normalized("NFC", text) else compose("NFC", text)
    out = out.replace("\r\n", "\n").replace("\r", "\n")
    if "|" in out:
        for pattern, by in _PIPES:
            out = pattern.sub(by, out)
    if "।" in out:
        out = _DANDAS.sub("॥", out)
    if "  " in out or "\t" in out or "\xa0" in out or "\u200b" in out:
        out = _BLANKS.sub(" ", out)
    out = "\n".join([line.strip() for line in out.split("\n")])
    if "\n\n\n" in out:
        out = _EMPTY_LINES.sub("\n\n", out)
    return out.strip()


def devanagari_share(text: Column) -> Column:
    """Devanagari letters and marks among all letters and marks; null without any."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{M}]", ""))
    own = F.length(F.regexp_replace(text, rf"[^{DEVANAGARI}&&[\p{{L}}\p{{M}}]]|[^{DEVANAGARI}]", ""))
    return F.try_divide(own.cast("double"), letters.cast("double"))


def is_devanagari(text: Column, threshold: float = 0.3) -> Column:
    return F.coalesce(devanagari_share(text) >= threshold, F.lit(False))


def split_sentences(paragraph: Column) -> Column:
    return F.filter(F.transform(F.split(paragraph, SENTENCE_END), strip), lambda s: s != "")


_END = re.compile(rf"[।॥?!.]{GAP}+")
_BEGIN = re.compile(rf"[A-Z{DEVANAGARI}\"“']")


def sentences(paragraph: str) -> Iterator[str]:
    """``split_sentences`` of one paragraph, for code that has its rows in Python."""
    start = 0
    for m in _END.finditer(paragraph):
        if paragraph[m.start()] != "." or _BEGIN.match(paragraph, m.end()):
            if whole := paragraph[start : m.start() + 1].strip():
                yield whole
            start = m.end()
    if whole := paragraph[start:].strip():
        yield whole


def tokenize(text: Column, composed: bool = False) -> Column:
    """Index terms in order, repeats included; ``composed`` says that the text without case is in composed form already."""
    low = F.lower(text)
    plain = F.translate(low if composed else nfc(low), CHANDRABINDU + NUKTA, ANUSVARA)
    return F.filter(F.regexp_extract_all(plain, F.lit(f"({TERM})"), F.lit(1)), lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS))


def token_id(term: Column) -> Column:
    """31-bit checksum of the UTF-8 bytes."""
    return F.crc32(F.encode(term, "UTF-8")).bitwiseAND(F.lit(0x7FFFFFFF))


def contextual_text(title: Column, section: Column, text: Column) -> Column:
    """What is embedded of a chunk."""
    return F.concat(title, F.when(section != "", F.concat(F.lit(" | "), section)).otherwise(""), F.lit("\n"), text)


def sparse_text(section: Column, text: Column) -> Column:
    """What is indexed of a chunk."""
    return F.concat(section, F.lit(" "), text)


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, rf"(?U)[^\w.\-{DEVANAGARI} ]+", "_")


def page_label(start: Column, end: Column, dash: str = "-") -> Column:
    return F.when(start == end, F.format_string("p. %d", start)).otherwise(F.format_string(f"pp. %d{dash}%d", start, end))


def excerpt(text: Column, chars: int = 700) -> Column:
    return F.concat(F.substring(text, 1, chars), F.when(F.length(text) > chars, "…").otherwise(""))


def content_id(content: Column) -> Column:
    """Identity of a file: the first 16 hexadecimal digits of its SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 16)


# Fixed value: the namespace under which points are named.
POINT_NAMESPACE = "5b0f6c1e8b8e4c9a9a510a6f3d1f2e77"


def point_id(doc_id: Column, chunk_index: Column, namespace: str = POINT_NAMESPACE) -> Column:
    """Version 5 UUID of ``doc_id:chunk_index``."""
    name = F.concat(doc_id.cast("string"), F.lit(":"), chunk_index.cast("string"))
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def is_heading(text: Column, style: Column) -> Column:
    """Whether a paragraph of a word-processor file is a heading, from its text and style name."""
    upper, letters = F.regexp_count(text, F.lit(r"\p{Lu}")), F.regexp_count(text, F.lit(r"\p{L}"))
    name = F.lower(F.coalesce(style, F.lit("")))
    return (
        F.when(name.startswith("heading") | name.startswith("title"), True)
        .when((F.length(text) > 90) | text.rlike(r"[.,;:]\z"), False)
        .when(letters < 2, False)
        .when(upper >= 0.9 * letters, True)
        .otherwise((name == "center") & (F.length(text) <= 60) & ~text.rlike(r"[?!]\z"))
    )
