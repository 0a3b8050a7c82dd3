"""Toxicity classifier with counterfactual regularisation.

A logistic model over the presence of words and word beginnings. Every labelled text that mentions a group is also seen
with its identity terms swapped for others of the same kind, and the loss adds the squared change of the score, so the
mention of a group by itself cannot carry the score. Terms are those of a list and those found in the labelled rows: words
that toxic rows have more often than clean ones although most rows that have them are clean, so a plain model would blame
whoever is mentioned by them. A found term is swapped for the found term whose neighbouring words are most like its own.

Training takes a bounded sample: the ``rows`` labelled documents with the smallest hash of their id, their whole texts.
Features are the ``features`` words and beginnings with the highest information value in that sample. Scoring reads whole
texts of all rows.

Defined results: null and empty texts score the model's base rate; without labelled rows of both classes every text has
score 0; repeated rows score alike; labels without a document and documents without a label are fine; a document
labelled more than once counts as toxic if any label says so; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafstack.llm._common import arrow_batches, pieces, release_memory, text_or_empty, written
from leafstack.llm._units import Units, word_of, words

BEGINNINGS = (4, 5, 6)

#: Identity terms by kind and language; a term is swapped for the next one of its list. Fixed values.
IDENTITY_TERMS = (
    ("woman", "man", "person"),
    ("women", "men", "people"),
    ("girl", "boy", "child"),
    ("gay", "lesbian", "bisexual", "straight", "queer"),
    ("transgender", "cisgender", "nonbinary"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("african", "european", "american", "mexican", "chinese", "indian", "arab"),
    ("immigrant", "refugee", "citizen"),
    ("immigrants", "refugees", "citizens"),
    ("deaf", "blind", "disabled"),
    ("old", "young", "elderly"),
    ("femme", "homme"),
    ("femmes", "hommes"),
    ("musulman", "chrétien", "juif", "hindou", "athée"),
    ("frau", "mann"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden", "hindus", "atheisten"),
    ("mujer", "hombre"),
    ("mujeres", "hombres"),
    ("musulmán", "cristiano", "judío", "hindú", "ateo"),
)

def swaps(groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> dict[str, str]:
    out: dict[str, str] = {}
    for g in groups:
        for a, b in zip(g, (*g[1:], g[0])):
            out.setdefault(a, b)
    return out


def features_of(word: str) -> list[str]:
    """The word itself and its beginnings, marked so that the two kinds differ."""
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)] if word else []


@dataclass
class Model:
    """``swapped``: the terms and what they were swapped for; ``pairs``: the labelled rows that were also seen swapped."""

    base: float = -math.inf
    weights: dict[str, float] = field(default_factory=dict)
    swapped: dict[str, str] = field(default_factory=dict)
    pairs: int = 0

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        self.base = model.base
        self.names = pa.array(list(model.weights), pa.string())
        self.weights = np.array(list(model.weights.values()), float)

    def features(self, units: pa.Array) -> np.ndarray:
        """Of each unit the feature that its word is, and those that its beginnings are; -1 for none."""
        own = words(units)
        length = pc.utf8_length(own)
        keys = [own]
        for n in BEGINNINGS:
            beginning = pc.binary_join_element_wise(pc.utf8_slice_codeunits(own, 0, n), "*", "")
            keys.append(pc.if_else(pc.greater(length, n), beginning, pa.scalar(None, pa.string())))
        return np.column_stack([pc.fill_null(pc.index_in(k, value_set=self.names), -1).to_numpy(zero_copy_only=False) for k in keys])

    def present(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (text, feature), each once, by text."""
        units = Units.of(texts)
        rows = self.features(units.dictionary)
        text_of = np.repeat(np.arange(len(texts)), np.diff(units.bounds))
        take = (rows >= 0).any(axis=1)[units.codes]
        size = max(len(rows), 1)
        pairs = np.unique(text_of[take] * size + units.codes[take])
        text_of, found = np.repeat(pairs // size, rows.shape[1]), rows[pairs % size].ravel()
        pairs = np.unique(text_of[found >= 0] * max(len(self.names), 1) + found[found >= 0])
        return pairs // max(len(self.names), 1), pairs % max(len(self.names), 1)

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.base == -math.inf:
            return np.zeros(len(texts))
        text_of, feature = self.present(texts)
        logit = self.base + np.bincount(text_of, weights=self.weights[feature], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


_SLOTS = 64


def _alike(sample: DataFrame, terms: list[str]) -> dict[str, str]:
    """Pairs of terms, each with the one whose neighbouring words are most like its own; words are counted in ``_SLOTS`` places."""
    number = {t: i for i, t in enumerate(terms)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(terms), 2 * _SLOTS), np.int64)
        for batch in batches:
            for t in batch.column("text").to_pylist():
                ws = [w for u in t.split() if (w := word_of(u))]
                for k, w in enumerate(ws):
                    if (i := number.get(w)) is not None:
                        if k:
                            seen[i, xxhash.xxh32_intdigest(ws[k - 1]) % _SLOTS] += 1
                        if k + 1 < len(ws):
                            seen[i, _SLOTS + xxhash.xxh32_intdigest(ws[k + 1]) % _SLOTS] += 1
        at = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*at, seen[at])], names=["term", "slot", "n"])

    table = np.zeros((len(terms), 2 * _SLOTS))
    for r in sample.mapInArrow(count, "term long, slot long, n long").groupBy("term", "slot").agg(F.sum("n").alias("n")).collect():
        table[r.term, r.slot] = r.n
    table = np.sqrt(table / np.maximum(table.sum(axis=1, keepdims=True), 1))  # so the product is how much two spreads share
    like = np.round(table @ table.T, 9)
    out: dict[str, str] = {}
    pairs = sorted((-like[i, j], i, j) for i in range(len(terms)) for j in range(i + 1, len(terms)))
    for _, i, j in pairs:
        if terms[i] not in out and terms[j] not in out:
            out |= {terms[i]: terms[j], terms[j]: terms[i]}
    return out


def fit(rows: list[tuple[int, list[int], list[int] | None]], n_features: int, counterfactual: float = 1.0, ridge: float = 1e-4, steps: int = 400) -> tuple[float, np.ndarray]:
    """Base and weights from rows (label, features, features with the identity terms swapped or None)."""
    y = np.array([r[0] for r in rows], float)
    pairs = [(i, r[2]) for i, r in enumerate(rows) if r[2] is not None]

    def sparse(lists):
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([f for x in lists for f in x], np.int64)

    r, c = sparse([x[1] for x in rows])
    pr, pc_ = sparse([x[1] for x in pairs])
    own = np.array([i for i, _ in pairs], np.int64)
    w, b = np.zeros(n_features), math.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(r, weights=w[c], minlength=len(y)), -40, 40)))
        d = (p - y) / len(y)
        g = np.append(np.bincount(c, weights=d[r], minlength=n_features) + ridge * w, d.sum())
        if pairs:
            q = 1 / (1 + np.exp(-np.clip(b + np.bincount(pr, weights=w[pc_], minlength=len(pairs)), -40, 40)))
            gap = 2 * counterfactual * (p[own] - q) / len(pairs)
            for rows_, cols, change in ((r, c, np.bincount(own, weights=gap * p[own] * (1 - p[own]), minlength=len(y))), (pr, pc_, -gap * q * (1 - q))):
                g[:-1] += np.bincount(cols, weights=change[rows_], minlength=n_features)
                g[-1] += change.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = (0.2 if step < steps * 0.7 else 0.05) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return b, w


def train(
    df: DataFrame,
    labels: DataFrame,
    ident: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    rows: int = 16_384,
    features: int = 2048,
    least: int = 3,
    counterfactual: float = 5.0,
    groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS,
    found_terms: int = 64,
) -> Model:
    """Fit on the rows of ``df`` that ``labels`` marks; at most ``rows`` of them, and ``features`` features, reach the driver.

    ``found_terms``: how many terms are taken from the labelled rows, beside those of ``groups``.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col(ident).isNotNull()).select(ident, F.col(label).cast("int").alias("_y"))
    chosen = marked.groupBy(ident).agg(F.max("_y").alias("_y")).orderBy(F.xxhash64(ident), ident).limit(rows)
    # ``rows`` pairs of numbers, so the broadcast has a fixed bound
    sample = written(df.select(ident, text_or_empty(text).alias("text")).join(F.broadcast(chosen), ident).select("_y", "text"), "labelled")
    arrow_batches(df.sparkSession)
    swap = swaps(groups)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for y, t in zip(batch.column("_y").to_pylist(), batch.column("text").to_pylist()):
                seen[y > 0].update({f for w in {word_of(u) for u in t.split()} for f in features_of(w)})
        names = list(seen[0].keys() | seen[1].keys())
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([s[f] for f in part], pa.int64()) for s in seen)], names=["feature", "clean", "toxic"])

    n = {r["toxic"]: r["n"] for r in sample.groupBy((F.col("_y") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Model()
    counted = sample.mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    a, b = (F.col("t") + 0.5) / (n[True] + 1), (F.col("c") + 0.5) / (n[False] + 1)
    value = (a - b) * F.log(a / b)
    counted = written(counted.where(F.col("t") + F.col("c") >= least), "features")
    best = [r.feature for r in counted.orderBy(value.desc(), "feature").limit(features).collect()]
    # words that are no better known than by a fifth of the rows, blamed more than praised, and clean in most rows
    blamed = counted.where((a > b) & (F.col("c") > F.col("t")) & (5 * (F.col("t") + F.col("c")) <= n[True] + n[False]) & ~F.col("feature").endswith("*") & (F.length("feature") > 1))
    terms = [r.feature for r in blamed.orderBy(value.desc(), "feature").limit(found_terms).collect()]
    swap = _alike(sample, [t for t in terms if t not in swap]) | swap
    names = {f: i for i, f in enumerate(dict.fromkeys([*best, *swap]))}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = lambda ws: sorted({names[f] for w in ws for f in features_of(w) if f in names})
        for batch in batches:
            own, swapped = [], []
            for t in batch.column("text").to_pylist():
                ws = {word_of(u) for u in t.split()}
                own.append(found(ws))
                swapped.append(found({swap.get(w, w) for w in ws}) if any(w in swap for w in ws) else None)
            yield pa.RecordBatch.from_arrays([batch.column("_y"), pa.array(own, pa.list_(pa.int32())), pa.array(swapped, pa.list_(pa.int32()))], names=["y", "own", "swapped"])

    data = sample.mapInArrow(encode, "y int, own array<int>, swapped array<int>").collect()
    data = [(int(r.y > 0), list(r.own), None if r.swapped is None else list(r.swapped)) for r in data]
    base, weights = fit(data, len(names), counterfactual)
    return Model(base, {f: float(weights[i]) for f, i in names.items()}, swap, sum(r[2] is not None for r in data))


def score(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and score double (0 to 1)."""
    arrow_batches(df.sparkSession)
    df = df.select(*keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            for b in pieces(batch, text):
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(scorer.score(b.column(text)), pa.float64())], names=[*keep, "score"])
        release_memory()

    return df.mapInArrow(run, T.StructType([*(df.schema[k] for k in keep), T.StructField("score", T.DoubleType())]))


def accepted(df: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``df`` that score below ``threshold``, with all their columns."""
    arrow_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            for b in pieces(batch, text):
                yield b.filter(pa.array(scorer.score(b.column(text)) < threshold))
        release_memory()

    return df.mapInArrow(run, df.schema)
