"""Token counts by a compiled finite-state tokenizer.

A deterministic transducer reads the symbols of a word and carries, on every transition, how many tokens the BPE of
the prefix gains (or loses) by that symbol. Its state holds what later symbols can still need: each start from which a
vocabulary entry may yet be completed, the token that ends before that start, and the count up to there relative to
now. Of the entries that a symbol completes, exactly one stays apart from the token before it, and that one is the last
token of the longer prefix. States and transitions are compiled when first reached and kept, so the machine is
deterministic and each transition is decided once.

A chunk of symbols maps every state that the machine can come in with to the state it leaves with and the tokens gained.
Such maps compose associatively whatever the chunks hold, and a parallel prefix scan combines those of a text. A map keeps
a few entries: that of the state which the symbols before the chunk lead to from a fresh start, and any others that
composing asks for, which are run then. White space resets the machine, so the map of a chunk that ends at white space is
constant; only words longer than a chunk are cut elsewhere.

Defined results: a null or empty text, or one of white space only, has 0 tokens; special strings in a text count one,
as in the library's default; repeated rows count alike; an empty table gives an empty table; further columns are
dropped except those named in ``keep``.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from leafstack.llm._common import arrow_batches, pieces, release_memory
from leafstack.llm._units import Memo, Units, sums
from leafstack.llm.speculative_bpe import WordBpe, byte_level, ids_of_units, word_bpe

CHUNK = 1 << 14
X = TypeVar("X")

#: One start that can still become a token: the symbols read since, the token before it (-1: word start), its count
#: relative to the count now.
Start = tuple[str, int, int]
State = tuple[Start, ...]
FRESH: State = (("", -1, 0),)


class CountTransducer:
    """Lazily compiled; ``limit`` states at most are kept before it starts anew."""

    def __init__(self, bpe: WordBpe, limit: int = 300_000):
        self.bpe, self.limit = bpe, limit
        self.open = {s[:k] for s in [*bpe.inner, *bpe.final] for k in range(1, len(s))}
        self.apart: dict[tuple[int, int], bool] = {}
        self._clear()

    def _clear(self) -> None:
        self.states: list[State] = [FRESH]
        self.number = {self.states[0]: 0}
        self.steps: list[dict[str, tuple[int, int]]] = [{}]
        self.ends: list[dict[str, int]] = [{}]

    def _stays(self, before: int, token: int) -> bool:
        key = before, token
        if key not in self.apart:
            bpe = self.bpe
            self.apart[key] = bpe.merged(bpe.symbols_of(token)) == [token] and (before < 0 or bpe.merged(bpe.symbols_of(before) + bpe.symbols_of(token)) == [before, token])
        return self.apart[key]

    def _last_token(self, state: int, symbol: str, vocab: dict[str, int]) -> tuple[int, int]:
        for read, before, count in self.states[state]:
            token = vocab.get(read + symbol)
            if token is not None and self._stays(before, token):
                return token, count + 1
        raise AssertionError("every symbol is a token, so one candidate always stays")

    def step(self, state: int, symbol: str) -> tuple[int, int]:
        """Compile the transition: the next state and the tokens gained."""
        token, gained = self._last_token(state, symbol, self.bpe.inner)
        after = [(read + symbol, before, count - gained) for read, before, count in self.states[state] if read + symbol in self.open]
        key = (*after, ("", token, 0))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            self.ends.append({})
        out = self.steps[state][symbol] = self.number[key], gained
        return out

    def end(self, state: int, symbol: str) -> int:
        out = self.ends[state][symbol] = self._last_token(state, symbol, self.bpe.final if self.bpe.suffix else self.bpe.inner)[1]
        return out

    def count(self, word: str) -> int:
        if len(self.states) > self.limit:
            self._clear()
        state, total = self._read(0, word[:-1])
        gained = self.ends[state].get(word[-1])
        return total + (self.end(state, word[-1]) if gained is None else gained)

    def _read(self, state: int, symbols: str) -> tuple[int, int]:
        total, steps = 0, self.steps
        for symbol in symbols:
            move = steps[state].get(symbol) or self.step(state, symbol)
            state = move[0]
            total += move[1]
        return state, total

    def run(self, state: State, symbols: str, ends: bool = False) -> tuple[State, int]:
        """The state after ``symbols`` and the tokens gained; with ``ends`` the last symbol ends the word.

        States are given by what they hold, not by number, so the machine can be cleared between two runs.
        """
        if len(self.states) > self.limit:
            self._clear()
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
            self.ends.append({})
        after, total = self._read(self.number[state], symbols[:-1] if ends else symbols)
        if not ends:
            return self.states[after], total
        gained = self.ends[after].get(symbols[-1])
        return FRESH, total + (self.end(after, symbols[-1]) if gained is None else gained)


class StateMap:
    """What a chunk does to the machine: from a state to the next state and the tokens gained; run once for each state."""

    def __init__(self, run: Callable[[State], tuple[State, int]]):
        self.run, self.known = run, {}

    def __call__(self, state: State) -> tuple[State, int]:
        if state not in self.known:
            self.known[state] = self.run(state)
        return self.known[state]


def composed(a: StateMap, b: StateMap) -> StateMap:
    """First ``a``, then ``b``, for the states that ``a`` knows; others are run when they are asked for."""

    def run(state: State) -> tuple[State, int]:
        between, n = a(state)
        after, m = b(between)
        return after, n + m

    out = StateMap(run)
    for state in list(a.known):
        out(state)
    return out


def prefix_scan(items: list[X], compose: Callable[[X, X], X]) -> list[X]:
    """All prefixes combined, in a logarithmic number of rounds whose compositions are independent of each other."""
    out, shift = list(items), 1
    while shift < len(out):
        out = out[:shift] + [compose(out[i - shift], out[i]) for i in range(shift, len(out))]
        shift *= 2
    return out


_SPACE = re.compile("[\\x20\\x09-\\x0d]")
_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def spans(text: str, chunk: int) -> Iterator[tuple[int, int]]:
    """Parts of a text of at most ``chunk`` code points that end after white space; a longer one if it has no white space."""
    x, n = 0, len(text)
    while x < n:
        y = min(n, x + chunk)
        if y < n:
            y = max(text.rfind(c, x, y) for c in _SPACES) + 1
            if not y:
                m = _SPACE.search(text, x + chunk)
                y = m.start() if m else n
        yield x, y
        x = y


class TokenCounter:
    def __init__(self, path: str):
        self.bpe = word_bpe(path)
        self.machine = CountTransducer(self.bpe)
        self.word_counts = Memo(lambda words: [self.machine.count(byte_level(w)) if w else 0 for w in words])
        self.other_counts = Memo(self._count_units, 10_000)

    def _count_units(self, units: list[str]) -> list[int]:
        return [sum(1 if isinstance(w, int) else self.machine.count(w) for w in self.bpe.pretokens(u)) for u in units]

    def _units(self, units: pa.Array) -> np.ndarray:
        """Tokens of each unit."""
        one = lambda counts: (np.array(counts, np.int64), np.ones(len(counts), np.int64))
        flat, lengths = ids_of_units(units, lambda words: one(self.word_counts(words.to_pylist())), lambda units: [(n,) for n in self.other_counts(units)])
        return sums(flat, np.concatenate([[0], np.cumsum(lengths)]))

    def _short(self, texts: pa.Array) -> np.ndarray:
        units = Units.of(texts)
        return sums(self._units(units.dictionary)[units.codes], units.bounds)

    def word_maps(self, word: str, chunk: int) -> list[StateMap]:
        """A word cut into chunks, each with the state that the ``bpe.longest`` symbols before it lead to."""
        out = []
        for x in range(0, len(word), chunk):
            part = functools.partial(self.machine.run, symbols=word[x : x + chunk], ends=x + chunk >= len(word))
            out.append(StateMap(part))
            out[-1](self.machine.run(FRESH, word[max(0, x - self.bpe.longest) : x])[0])
        return out

    def long_unit(self, unit: str, chunk: int) -> list[StateMap]:
        """Maps of a unit of more than ``chunk`` code points."""
        out, n = [], 0
        for w in self.bpe.pretokens(unit):
            if isinstance(w, str) and len(w) > chunk:
                out += self.word_maps(w, chunk)
            else:
                n += 1 if isinstance(w, int) else self.machine.count(w)
        return [*out, StateMap(lambda _: (FRESH, n))]

    def count(self, texts: pa.Array, chunk: int = CHUNK) -> np.ndarray:
        texts = texts.fill_null("")
        long = pc.greater(pc.utf8_length(texts), chunk).to_numpy(zero_copy_only=False)
        out = self._short(pc.if_else(pa.array(long), "", texts))
        for i in np.nonzero(long)[0].tolist():
            out[i] = self.long_text(texts[i].as_py(), chunk)
        return out

    def long_text(self, text: str, chunk: int = CHUNK) -> int:
        parts = list(spans(text, chunk))
        counts = self._short(pa.array([text[x:y] if y - x <= chunk else "" for x, y in parts], pa.string()))
        maps: list[StateMap] = []
        for (x, y), n in zip(parts, counts.tolist()):
            maps += self.long_unit(text[x:y], chunk) if y - x > chunk else [StateMap(lambda _, n=n: (FRESH, n))]
            maps[-1](FRESH)
        return prefix_scan(maps, composed)[-1](FRESH)[1] if maps else 0


@functools.cache
def token_counter(path: str) -> TokenCounter:
    """One per worker process."""
    return TokenCounter(path)


def count_tokens(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 2048) -> DataFrame:
    """Columns ``keep``, n_bytes long (UTF-8), n_tokens long, over_limit boolean (more than ``limit`` tokens)."""
    arrow_batches(df.sparkSession)
    df = df.select(*keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(path)
        for batch in batches:
            for b in pieces(batch, text):
                n = counter.count(b.column(text))
                n_bytes = pc.binary_length(b.column(text)).fill_null(0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), n_bytes, pa.array(n, pa.int64()), pa.array(n > limit)], names=[*keep, "n_bytes", "n_tokens", "over_limit"])
        release_memory()

    schema = [*(df.schema[k] for k in keep), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return df.mapInArrow(run, T.StructType(schema))
