"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of labelled text. A text is parsed against it into longest matches; the language in
whose text it falls into the fewest phrases, times the bits that point into that language's text, wins. The automaton is
turned into a table of moves that also say how many phrases a move completes, so all texts of a batch are parsed side by
side, one symbol of each at a time. A long text is parsed from several places at once: the parse that comes from the left
goes on past the next place until it is in the state which the parse from there has, and from then on they are one.

Symbols are letters of the labelled text without case; every run of other characters is one separator; letters that no
labelled text has match nothing. The commonest letters are a symbol each and the others two, so tables stay narrow
however many letters there are. Training takes a bounded sample: of each language, among the labelled documents of at most
``symbols`` code points, the ``rows`` with the smallest hash of their id, of those the whole texts that together have up to
``symbols`` code points, in that order; where all are longer, a part of the shortest one. Prediction reads whole texts.

Defined results: null text, or one without a letter, is ``und`` with score 0; so is every text if nothing is labelled;
ties go to the language that sorts first; an empty table gives an empty table; repeated rows get equal predictions;
other columns are not read.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafstack.llm._common import arrow_batches, pieces

BLOCK = 256
SEPARATOR, UNKNOWN = 0, 1
#: Letters that are a symbol of their own; each further one is two, of as many first and second ones as needed.
SINGLES = 93


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Moves of the automaton that accepts exactly the substrings of ``text``; state 0 is the empty one."""
    moves, link, length, last = [{}], [-1], [0], 0
    for c in text:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


def move_table(text: list[int], classes: int) -> np.ndarray:
    """``table[state + symbol]`` is the next state (a multiple of classes + 1) times 4 plus the phrases completed.

    The symbol ``classes`` ends the text: it completes the phrase that is open.
    """
    moves, width = suffix_automaton(text), classes + 1
    start = np.full(width, 1, np.int32)  # from the empty state an unmatched symbol is a phrase of its own
    for c, s in moves[0].items():
        start[c] = s * width << 2
    start[classes] = 0
    table = np.tile(start + 1, (len(moves), 1))
    table[0] = start
    table[1:, classes] = 1
    for s, m in enumerate(moves):
        for c, t in m.items():
            table[s, c] = t * width << 2
    return table.ravel()


@functools.cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000)


@dataclass(frozen=True)
class Model:
    """What the driver sends: the alphabet, commonest letters first, and each language's labelled symbols (16 bits each)."""

    letters: str
    langs: tuple[str, ...]
    texts: tuple[bytes, ...]

    @functools.cached_property
    def base(self) -> int:
        """The number of second symbols, and about that of first ones, of letters that are two symbols."""
        return ceil(sqrt(max(len(self.letters) - SINGLES, 0)))

    @functools.cached_property
    def size(self) -> int:
        """All symbols; the next number ends a text."""
        return 2 + min(len(self.letters), SINGLES) + 2 * self.base

    @functools.cached_property
    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """The first and the second symbol (0: none) of every code point."""
        known = {}
        for i, c in enumerate(self.letters):
            at, second = divmod(i - SINGLES, self.base) if i >= SINGLES else (0, 0)
            top = 2 + min(len(self.letters), SINGLES)
            known[c] = (i + 2, 0) if i < SINGLES else (top + at, top + self.base + second)
        first = np.where(_letters(), UNKNOWN, SEPARATOR).astype(np.uint16)
        second = np.zeros(0x110000, np.uint16)
        for p in np.nonzero(_letters())[0].tolist():
            if (pair := known.get(chr(p).lower())) is not None:
                first[p], second[p] = pair
        return first, second

    def symbols(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all texts with runs of separators merged, their bounds, and which texts have a letter."""
        texts = texts.fill_null("")
        bounds = np.concatenate([[0], np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))]).astype(np.int64)
        points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        out, second = (c[points] for c in self.classes)
        letters = np.concatenate([[0], np.cumsum(out != SEPARATOR)])[bounds]
        keep = out != SEPARATOR
        keep[1:] |= out[:-1] != SEPARATOR
        times = keep.astype(np.int64) + (second > 0)
        ends = np.concatenate([[0], np.cumsum(times)])
        found = np.repeat(out, times)
        found[ends[1:][second > 0] - 1] = second[second > 0]
        return found, ends[bounds], np.diff(letters) > 0

    @functools.cached_property
    def tables(self) -> list[np.ndarray]:
        return [move_table(np.frombuffer(t, "<u2").tolist(), self.size) for t in self.texts]

    def phrases(self, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns)."""
        sizes, end = np.diff(bounds), self.size
        lanes = sizes // BLOCK + 1  # so the last lane of a text always comes to its end
        text_of = np.repeat(np.arange(len(sizes)), lanes)
        within = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = bounds[:-1][text_of] + within * BLOCK
        left = bounds[1:][text_of] - start
        padded = np.append(symbols, np.zeros(BLOCK, symbols.dtype))
        out = np.zeros((len(sizes), len(self.langs)), np.int64)
        for k, table in enumerate(self.tables):
            states, counts = np.zeros((BLOCK, len(start)), np.int32), np.zeros((BLOCK, len(start)), np.int16)
            for x in range(0, len(start), 4096):
                state, count = np.zeros(len(start[x : x + 4096]), np.int32), np.zeros(len(start[x : x + 4096]), np.int16)
                for j in range(BLOCK):
                    move = table[state + np.where(j < left[x : x + 4096], padded[start[x : x + 4096] + j], end)]
                    count += (move & 3).astype(np.int16)
                    state = move >> 2
                    states[j, x : x + 4096], counts[j, x : x + 4096] = state, count
            total = counts[-1].astype(np.int64)
            unmet = self._joined(table, padded, start, left, states, counts, np.nonzero(within[1:] > 0)[0], total)
            out[:, k] = np.bincount(text_of, weights=total, minlength=len(sizes))
            for i in np.unique(text_of[unmet]).tolist():
                out[i, k] = _one_by_one(table, symbols[bounds[i] : bounds[i + 1]].tolist(), end)
        return out

    def _joined(self, table, padded, start, left, states, counts, lane, total) -> np.ndarray:
        """Go on from the end of each ``lane`` into the next until the states are equal; the lanes where they never are.

        ``total``: to the phrases of each lane are added those found past its end, and taken off those before it was met.
        """
        state = states[-1, lane]
        for j in range(BLOCK):
            if not len(lane):
                break
            move = table[state + np.where(j < left[lane + 1], padded[start[lane + 1] + j], self.size)]
            total[lane] += move & 3
            state = move >> 2
            met = state == states[j, lane + 1]
            total[lane[met] + 1] -= counts[j, lane[met] + 1]
            lane, state = lane[~met], state[~met]
        return lane

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        symbols, bounds, lettered = self.symbols(texts)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        bits = np.log2([len(t) // 2 + 2 for t in self.texts])
        cost = np.maximum(self.phrases(symbols, bounds), 1) * bits
        best = cost.argmin(axis=1)
        score = (1 / cost.min(axis=1)) / (1 / cost).sum(axis=1)
        return [self.langs[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist())], np.where(lettered, score, 0.0)


def _one_by_one(table: np.ndarray, symbols: list[int], end: int) -> int:
    state = total = 0
    for c in [*symbols, end]:
        move = int(table[state + c])
        total += move & 3
        state = move >> 2
    return total


@functools.lru_cache(maxsize=2)
def _held(model: Model) -> Model:
    """The model whose tables this worker process has built."""
    return model


def train(df: DataFrame, ident: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = 64, symbols: int = 20_000, langs: int = 400) -> Model:
    """Fit on the labelled rows of ``df`` (non-null ``lang``); at most ``rows`` texts of a language reach the driver.

    Texts are taken whole while they fit into ``symbols`` code points a language. A language whose texts are all longer is
    learned from that many code points of its shortest one. Beyond ``langs`` languages each gets a smaller share of
    ``symbols`` x ``langs``, so the model stays as large. Of rows that repeat an id with one language the least text counts.
    """
    labelled = df.where(F.col(lang).isNotNull() & F.col(ident).isNotNull() & F.col(text).isNotNull())
    each = symbols * langs // max(langs, labelled.select(lang).distinct().count())
    sized = labelled.select(ident, lang, F.greatest(F.length(text) - each, F.lit(0)).alias("over"))
    rank = F.row_number().over(Window.partitionBy(lang).orderBy("over", F.xxhash64(ident), ident))
    chosen = sized.withColumn("rank", rank).where((F.col("rank") <= rows) & ((F.col("over") == 0) | (F.col("rank") == 1))).select(ident, lang, "rank")
    # at most ``rows`` ids of a few bytes a language
    found = labelled.select(ident, lang, text).join(F.broadcast(chosen), [ident, lang]).groupBy(lang, "rank").agg(F.substring(F.min(text), 1, each).alias("t")).collect()
    by_lang: dict[str, list[str]] = {}
    room: dict[str, int] = {}
    for r in sorted(found, key=lambda r: (r[lang], r["rank"])):
        if len(r["t"]) <= room.get(r[lang], each):
            by_lang.setdefault(r[lang], []).append(r["t"])
            room[r[lang]] = room.get(r[lang], each) - len(r["t"])
    counts = Counter(c for ts in by_lang.values() for t in ts for c in t.lower() if c.isalpha())
    letters = "".join(c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])))
    model = Model(letters, (), ())
    learned = {name: model.symbols(pa.array(["\n".join(by_lang[name])]))[0] for name in sorted(by_lang)}
    names = [name for name, parts in learned.items() if len(parts)]
    return Model(letters, tuple(names), tuple(learned[n].astype("<u2").tobytes() for n in names))


def predict(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, lang_pred string, score double (the winner's share of the inverse costs)."""
    arrow_batches(df.sparkSession)
    df = df.select(*keep, text)
    shared = df.sparkSession.sparkContext.broadcast(model)  # ``symbols`` bytes a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _held(shared.value)
        for batch in batches:
            for b in pieces(batch, text):
                names, score = held.predict(b.column(text))
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(names, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    return df.mapInArrow(run, T.StructType([*(df.schema[k] for k in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
