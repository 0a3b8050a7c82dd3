"""Whether the text layer of a page can be trusted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafstack.functions.text import DEVANAGARI, strip

# Signs that never begin a word, the virama and the vowel signs it cannot precede, and ten very frequent words.
ORPHAN = "[ँ-ःा-्ॢॣ]"
VIRAMA_MATRA = "्[ा-ौ]"
FREQUENT_WORDS = ("कि", "लिए", "किया", "दिया", "किसी", "लिया", "जिस", "दिन", "फिर", "लिये")


# The defaults of the thresholds below.
def page_quality(
    text: Column,
    least_chars: int = 40,
    latin_share: float = 0.2,
    most_orphans: float = 0.01,
    few_words: int = 80,
    least_frequent: float = 0.004,
) -> Column:
    """Struct of chars, orphan_ratio, virama_matra, i_matra_ratio (both ratios rounded) and needs_ocr.

    Short pages need OCR; pages that are mostly Latin do not; others do if words begin with a dependent sign, if a virama
    precedes a vowel sign, or if a long page hardly has the frequent words. A page without any word is trusted.
    """
    bare = strip(F.coalesce(text, F.lit("")))
    words = F.regexp_extract_all(bare, F.lit(f"([{DEVANAGARI}]+)"), F.lit(1))
    n = F.size(words).cast("double")
    latin = F.regexp_count(bare, F.lit("[A-Za-z]{2,}"))
    share = lambda k: F.coalesce(F.try_divide(k.cast("double"), n), F.lit(0.0))
    orphans = share(F.size(F.filter(words, lambda w: w.rlike(f"^{ORPHAN}"))))
    frequent = share(F.size(F.filter(words, lambda w: w.isin(*FREQUENT_WORDS))))
    broken = F.regexp_count(bare, F.lit(VIRAMA_MATRA))
    short = F.length(bare) < least_chars
    trusted = (n == 0) | (n < latin_share * (n + latin))
    judged = ~short & ~trusted
    bad = (orphans > most_orphans) | (broken > 0) | ((n > few_words) & (frequent < least_frequent))
    return F.struct(
        F.length(bare).alias("chars"),
        F.when(judged, F.round(orphans, 4)).otherwise(0.0).alias("orphan_ratio"),
        F.when(judged, broken).otherwise(0).alias("virama_matra"),
        F.when(judged, F.round(frequent, 4)).otherwise(0.0).alias("i_matra_ratio"),
        F.when(short, True).when(trusted, False).otherwise(bad).alias("needs_ocr"),
    )
