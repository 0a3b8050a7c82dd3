from __future__ import annotations

import functools
import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    "",
    None,
    " \t\n ",
    "a <|endoftext|>b x<|startoftext|>'S 12 don't I'LL",
    "naïve café é ́x \xa0y z Ñ İ ΣΑΣ ß",
    "日本語 テスト 😀😀",
    "</w> <w/>'re'S\x01 a\x7fb",
    "x" * 3000 + "aab" * 300,
    "<|endoftext",
    "&&&!!!%%% $$$###*** dogs' 'tis",
    "ﬁ Ǆ ǅ µª º 'tis don''t",
]


def frame(spark, texts, extra=False):
    """documents with the given texts; ``extra`` adds columns whose names the operators use themselves."""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if extra:
        from pyspark.sql import functions as F

        for name in ("digest", "ids", "fp", "unit", "side", "score", "n", "rank", "keep_id", "ident", "size", "hash", "at"):
            df = df.withColumn(name, F.lit("clash"))
    return df


@functools.cache
def _pool(vocabulary):
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it"]
    return ["".join(random.Random(k).choices(parts, k=random.Random(k).randint(2, 4))) for k in range(vocabulary)]


def prose(seed, words=200, vocabulary=3000):
    r, pool = random.Random(seed), _pool(vocabulary)
    return " ".join(r.choice(pool) for _ in range(words))


def edited(text, seed, changes):
    r = random.Random(seed)
    words = text.split()
    for _ in range(changes):
        words[r.randrange(len(words))] = f"changed{r.randrange(10**6)}"
    return " ".join(words)
