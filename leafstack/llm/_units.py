"""Texts as sequences of whitespace-separated units, held as one dictionary per Arrow batch.

Work that depends on a unit alone (tokenising, canonicalising, feature lookup) is done once for each distinct unit
and spread over the texts by integer gathers.
"""

from __future__ import annotations

import functools
import gc
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


class Units:
    """``codes[bounds[i]:bounds[i + 1]]`` are the units of text i, as positions in ``names``."""

    def __init__(self, codes: np.ndarray, bounds: np.ndarray, dictionary: pa.Array):
        self.codes, self.bounds, self.dictionary = codes, bounds, dictionary

    @functools.cached_property
    def names(self) -> list[str]:
        return self.dictionary.to_pylist()

    @classmethod
    def of(cls, texts: pa.Array) -> Units:
        """Split at the ASCII white space [\\x20\\x09-\\x0D]; null counts as empty."""
        parts = pc.ascii_split_whitespace(texts.fill_null(""))
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))]).astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        codes, empty = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), pc.index(coded.dictionary, "").as_py()
        if empty >= 0:  # the splitter gives an empty unit at either end of a padded text
            keep = codes != empty
            ends = np.concatenate([[0], np.cumsum(keep)])[ends]
            codes = codes[keep]
        return cls(codes, ends, coded.dictionary)

    def spread(self, rows: list) -> tuple[np.ndarray, np.ndarray]:
        """``rows``: per name an int sequence, or the bytes of 32-bit integers. Returns all texts' sequences joined, and their bounds."""
        flat, lengths = ragged(rows)
        return gather(flat, lengths, self.codes, self.bounds)


def ragged(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Int sequences, or bytes of 32-bit integers, joined; and their lengths."""
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    if rows and isinstance(rows[0], bytes):
        return np.frombuffer(b"".join(rows), np.int32).astype(np.int64), lengths >> 2
    return np.fromiter(chain.from_iterable(rows), np.int64, lengths.sum()), lengths


def gather(flat: np.ndarray, lengths: np.ndarray, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace each code by its row of the ragged array ``flat``; also the bounds of the texts in the result."""
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1] if len(lengths) else np.zeros(0, np.int64)
    n = lengths[codes] if len(codes) else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    at = np.arange(ends[-1], dtype=np.int64) + np.repeat((starts[codes] if len(codes) else n) - ends[:-1], n)
    return flat[at], ends[bounds]


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between neighbouring bounds."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
ASCII_MARKS = "".join(c for c in map(chr, range(128)) if not c.isalnum())


def word_of(unit: str) -> str:
    """The unit without case and without marks at its ends."""
    return unit.lower() if unit.isalnum() else _EDGES.sub("", unit.lower())


def words(units: pa.Array) -> pa.Array:
    """``word_of`` of all units: in Arrow's kernels but for the few with other marks at their ends than ASCII ones."""
    out = pc.utf8_trim(pc.utf8_lower(units), characters=ASCII_MARKS)
    plain = pc.or_(pc.string_is_ascii(units), pc.and_(pc.utf8_is_alnum(out), pc.invert(pc.match_substring_regex(units, "[\u0130\u03a3]"))))
    odd = np.nonzero(~plain.to_numpy(zero_copy_only=False))[0]
    if len(odd):
        found = [word_of(u) for u in units.take(pa.array(odd)).to_pylist()]
        mask = np.zeros(len(units), bool)
        mask[odd] = True
        out = pc.replace_with_mask(out, pa.array(mask), pa.array(found, pa.string()))
    return out


_BASE = 0x9E3779B97F4A7C15
_BLOCK = 1 << 18  # bytes of strings that are hashed at once
_LONGEST = 1 << 10


def _powers(base: int) -> np.ndarray:
    out = np.full(_BLOCK + _LONGEST, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte; powers of the base and of its inverse modulo 2^64."""
    return np.random.default_rng(_BASE).integers(0, 1 << 64, 256, np.uint64), _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """64-bit values spread over all bits; each seed has its own one-to-one mapping."""
    h = h ^ np.uint64(seed)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashes(strings: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hashes of strings by their UTF-8 bytes: polynomials over a random number for each byte, then mixed.

    Differences of running sums give them for all strings at once; strings over ``_LONGEST`` bytes are hashed one by one.
    """
    byte, power, inverse = _tables()
    n = len(strings)
    ends = np.frombuffer(strings.buffers()[1], np.int32, n + 1, 4 * strings.offset).astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)
    lengths = np.diff(ends)
    out = np.zeros(n, np.uint64)
    long = lengths > _LONGEST
    for i in np.nonzero(long)[0].tolist():
        out[i] = xxhash.xxh64_intdigest(strings[i].as_buffer(), seed)
    x = 0
    while x < n:
        y = max(x + 1, int(np.searchsorted(ends, ends[x] + _BLOCK, "right")) - 1)
        part = slice(x, y)
        if not (y == x + 1 and long[x]):
            own = data[ends[x] : ends[y]]
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte[own] * power[: len(own)])])
            at = ends[x : y + 1] - ends[x]
            out[part] = np.where(long[part], out[part], (total[at[1:]] - total[at[:-1]]) * inverse[at[:-1]])
        x = y
    return mixed(out ^ lengths.astype(np.uint64) << np.uint64(56), seed)


class Memo:
    """Results by unit in two generations of ``limit`` each; the older goes when the younger is full.

    Frequent units are carried over by use, so a worker's memory stays bounded and the common words stay known.
    """

    def __init__(self, make: Callable[[list[str]], list], limit: int = 100_000):
        self.make, self.limit, self.young, self.old = make, limit, {}, {}
        gc.set_threshold(300_000, 20, 50)  # many small lists live long here; scanning them often costs more than it frees

    def __call__(self, names: list[str]) -> list:
        young, old = self.young, self.old
        out = list(map(young.get, names))
        absent = [i for i, x in enumerate(out) if x is None]
        missing = []
        for i in absent:
            x = names[i]
            if (known := old.get(x)) is None:
                missing.append(x)
            else:
                out[i] = young[x] = known
        if missing:
            young.update(zip(missing, self.make(missing), strict=True))
            for i in absent:
                if out[i] is None:
                    out[i] = young[names[i]]
        if len(young) > self.limit:
            self.young, self.old = {}, young
        return out
