"""BPE encoding and decoding by speculation and verification.

A greedy longest match proposes the tokens of each word. Merging in rank order gives exactly the proposal if every
token is what its own symbols merge to and every two neighbours stay apart when merged alone, so vectorised look-ups
test all neighbouring pairs of a batch. Only the words with a failing pair are merged step by step.

Defined results: a null or empty text has no ids and decodes to the empty string; rows keep their order and number,
repeated rows are encoded alike, further input columns are kept; an empty table gives an empty table. Ids are those of
the tokenizers library for the given file, with special strings in a text taken as its default does.
"""

from __future__ import annotations

import functools
import heapq
import json
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from leafstack.llm._common import arrow_batches, pieces, release_memory
from leafstack.llm._units import Memo, Units, gather, ragged

_PRINTABLE = regex.compile(r"[!-~]+")


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-in of every byte: itself where it is a printable character, else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(sorted(set(range(256)) - set(shown)))}


_BYTES = _byte_alphabet()


def byte_level(word: str) -> str:
    return word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES)


#: A unit of letters below U+0100 and then ASCII marks is at most two words: the letters without case, and the marks.
_SIMPLE = r"^(?P<w>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<m>[!-/:-@\[-`{-~]*)$"


def ids_of_units(units: pa.Array, of_words: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], of_others: Callable[[list[str]], list]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all units, joined, and how many each has.

    ``of_words`` gets each distinct word of the simple units once and gives the ids of all, joined, and how many each has;
    ``of_others`` gets the other units and gives a row for each.
    """
    parts = pc.extract_regex(units, _SIMPLE)
    simple = parts.is_valid().to_numpy(zero_copy_only=False)
    both = [pc.fill_null(x, "").dictionary_encode() for x in (pc.utf8_lower(pc.struct_field(parts, "w")), pc.struct_field(parts, "m"))]
    rows = [*(of_words(x.dictionary) for x in both), ragged(of_others(units.filter(pa.array(~simple)).to_pylist()))]
    lengths = np.concatenate([*(n for _, n in rows), [0]]).astype(np.int64)
    at = np.column_stack([x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in both]) + [0, len(rows[0][1])]
    first = len(rows[0][1]) + len(rows[1][1])
    at[~simple] = np.column_stack([first + np.arange(len(rows[2][1])), np.full(len(rows[2][1]), len(lengths) - 1)])
    flat, bounds = gather(np.concatenate([x for x, _ in rows]), lengths, at.ravel(), np.arange(0, 2 * len(at) + 1, 2))
    return flat, np.diff(bounds)


class WordBpe:
    """The merges of a tokenizer file whose pre-tokens never cross white space (BPE with a word-end suffix)."""

    #: Symbols of the longest words that are merged together.
    AT_ONCE = 48

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        model, self.library = spec["model"], Tokenizer.from_file(path)
        self.suffix = model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.words = regex.compile(self._split_pattern(spec["pre_tokenizer"]))
        self.strings = [""] * (max([*vocab.values(), *self.specials.values()]) + 1)
        for s, i in [*vocab.items(), *self.specials.items()]:
            self.strings[i] = s
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        n = len(self.suffix)
        self.final = {s[:-n]: i for s, i in vocab.items() if n and s.endswith(self.suffix)}
        self.inner = {s: i for s, i in vocab.items() if not (n and s.endswith(self.suffix))}
        self.longest = max(map(len, [*self.final, *self.inner]))
        self.pairs, self.selves = _Flags(self._apart), _Flags(self._whole)
        self.unit_ids = Memo(self._encode_units, 10_000)

    @staticmethod
    def _split_pattern(pre: dict) -> str:
        return next(p["pattern"]["Regex"] for p in pre["pretokenizers"] if p["type"] == "Split")

    def pretokens(self, unit: str) -> list[str | int]:
        """The words of a unit as byte-level strings; a special string is its id."""
        if not unit:
            return []
        # the commonest shapes need no pattern: letters below U+0250, with or without one mark after them
        if unit.isalpha():
            if max(unit) < "\u0250" and "\u0130" not in unit:
                return [byte_level(unit.lower())]
        elif unit[-1] in ",.!?;:" and (stem := unit[:-1]).isalpha() and max(stem) < "\u0250" and "\u0130" not in stem:
            return [byte_level(stem.lower()), unit[-1]]
        if self.special_pattern and "<|" in unit and self.special_pattern.search(unit):
            out, at = [], 0
            for m in self.special_pattern.finditer(unit):
                out += self.pretokens(unit[at : m.start()]) + [self.specials[m[0]]]
                at = m.end()
            return out + self.pretokens(unit[at:])
        if _PRINTABLE.fullmatch(unit):
            return self.words.findall(unit.lower())
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(unit))]

    def symbols(self, word: str) -> list[int]:
        return [self.inner[c] for c in word[:-1]] + [self.final[word[-1]] if self.suffix else self.inner[word[-1]]]

    def symbols_of(self, token: int) -> list[int]:
        s = self.strings[token]
        if self.suffix and s.endswith(self.suffix):
            return self.symbols(s[: -len(self.suffix)])
        return [self.inner[c] for c in s]

    def merged(self, symbols: list[int]) -> list[int]:
        """Exact merging: the lowest rank first, and of equal ranks the leftmost."""
        ids, n = list(symbols), len(symbols)
        if n <= 40:  # a scan for the lowest rank is faster than a heap while there is little to scan
            return self._merged_short(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heap = [(rank, i, new, a, b) for rank, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := self.merges.get((new, ids[after[i]])):
                    heapq.heappush(heap, (m[0], i, m[1], new, ids[after[i]]))
            if (p := before[i]) >= 0 and (m := self.merges.get((ids[p], new))):
                heapq.heappush(heap, (m[0], p, m[1], ids[p], new))
        return [x for x in ids if x >= 0]

    def _merged_short(self, ids: list[int]) -> list[int]:
        find, none = self.merges.get, (1 << 60, -1)
        best = [find(pair, none) for pair in zip(ids, ids[1:])]
        while best:
            low = min(best)
            if low is none:
                break
            i = best.index(low)
            ids[i : i + 2] = [low[1]]
            del best[i]
            if i:
                best[i - 1] = find((ids[i - 1], ids[i]), none)
            if i < len(best):
                best[i] = find((ids[i], ids[i + 1]), none)
        return ids

    @functools.cached_property
    def _rules(self) -> _Table:
        """Of a pair of tokens the rank of its merge, and the token that it gives."""
        pairs = np.array([(a << 20 | b, rank << 20 | new) for (a, b), (rank, new) in self.merges.items()], np.int64).reshape(-1, 2)
        return _Table(pairs[:, 0].copy(), pairs[:, 1].copy())

    @functools.cached_property
    def _spelled(self) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all tokens that are made of symbols, joined, and where each token's begin."""
        rows: list[list[int]] = [[] for _ in self.strings]
        known = [*((s, i, False) for s, i in self.inner.items()), *((s, i, True) for s, i in self.final.items())]
        for s, i, ends in known:
            if all(c in self.inner for c in s) and (not ends or s[-1] in self.final):
                rows[i] = self.symbols(s) if ends else [self.inner[c] for c in s]
        flat, lengths = ragged(rows)
        return flat, np.concatenate([[0], np.cumsum(lengths)])

    @functools.cached_property
    def _trie(self) -> tuple[_Table, np.ndarray, np.ndarray]:
        """Children of (node, byte), and the token that ends at each node inside a word and at a word's end (-1: none)."""
        number: dict[bytes, int] = {b"": 0}
        byte = {c: b for b, c in _BYTES.items()}
        ends: list[dict[int, int]] = [{}, {}]
        for kind, vocab in enumerate((self.inner, self.final if self.suffix else self.inner)):
            for s, token in vocab.items():
                if all(c in byte for c in s):
                    raw = bytes(byte[c] for c in s)
                    for k in range(1, len(raw) + 1):
                        number.setdefault(raw[:k], len(number))
                    ends[kind][number[raw]] = token
        keys = np.array([number[raw[:-1]] << 8 | raw[-1] for raw in number if raw], np.int64)
        tokens = np.full((2, len(number)), -1, np.int64)
        for kind, found in enumerate(ends):
            tokens[kind, list(found)] = list(found.values())
        return _Table(keys, np.arange(1, len(number))), tokens[0], tokens[1]

    def merge_all(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words at once: in each step every word merges its pair of the lowest rank, the leftmost of equals.

        Returns the tokens of all words, joined, and how many each has. Long words, which take many steps, are merged by a
        heap each.
        """
        none = 1 << 62
        word, symbols = np.repeat(np.arange(len(lengths)), lengths), symbols.astype(np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        if (long := lengths > self.AT_ONCE).any():
            ends = np.cumsum(lengths)
            for i in np.nonzero(long)[0].tolist():
                own = np.array(self.merged(symbols[ends[i] - lengths[i] : ends[i]].tolist()), np.int64)
                done.append((np.full(len(own), i), own))
            word, symbols = word[~long[word]], symbols[~long[word]]

        def ranked(at: np.ndarray) -> np.ndarray:
            """The merge of each position with the next one: its rank and token, or none."""
            out = np.full(len(at), none)
            inside = np.nonzero((at >= 0) & (at + 1 < len(word)))[0]
            inside = inside[word[at[inside]] == word[at[inside] + 1]]
            out[inside] = self._rules(symbols[at[inside]] << 20 | symbols[at[inside] + 1], none)
            return out

        rule = ranked(np.arange(len(word)))
        while len(word):
            start = np.nonzero(np.concatenate([[True], word[1:] != word[:-1]]))[0]
            low = np.minimum.reduceat(rule >> 20, start)
            size = np.diff(np.append(start, len(word)))
            ended = np.repeat(low == none >> 20, size)
            if ended.any():
                done.append((word[ended], symbols[ended]))
                word, symbols, rule = word[~ended], symbols[~ended], rule[~ended]
                if not len(word):
                    break
                size, low = size[low != none >> 20], low[low != none >> 20]
                start = np.cumsum(size) - size
            first = np.nonzero(rule >> 20 == np.repeat(low, size))[0]
            at = first[np.searchsorted(first, start)]  # the leftmost of each word
            symbols[at] = rule[at] & 0xFFFFF
            stay = np.ones(len(word), bool)
            stay[at + 1] = False
            word, symbols, rule = word[stay], symbols[stay], rule[stay]
            at = at - np.arange(len(at))  # each word lost one place
            rule[at] = ranked(at)
            left = at[at > 0] - 1
            rule[left] = ranked(left)
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(lengths), np.int64)
        word, symbols = (np.concatenate(x) for x in zip(*done))
        return symbols[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(lengths))

    def _whole(self, tokens: np.ndarray) -> np.ndarray:
        """Whether each token is what its own symbols merge to."""
        flat, start = self._spelled
        rows, lengths = _ranges(flat, start[tokens], start[tokens + 1])
        found, n = self.merge_all(rows, lengths)
        out = n == 1
        out[out] = found[(np.cumsum(n) - n)[out]] == tokens[out]
        return out

    def _apart(self, pairs: np.ndarray) -> np.ndarray:
        """Whether two neighbouring tokens stay as they are when their symbols are merged."""
        flat, start = self._spelled
        both = np.column_stack([pairs >> 20, pairs & 0xFFFFF]).ravel()
        rows, lengths = _ranges(flat, start[both], start[both + 1])
        found, n = self.merge_all(rows, lengths.reshape(-1, 2).sum(axis=1))
        out, first = n == 2, np.cumsum(n) - n
        out[out] = (found[first[out]] << 20 | found[first[out] + 1]) == pairs[out]
        return out

    def proposed(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match in all words at once, a byte of each in a step: the tokens, joined, and how many each word has."""
        children, inner, final = self._trie
        bounds, data = _bytes_of(words)
        end = bounds[1:]
        pos, reach, node, token = bounds[:-1].copy(), bounds[:-1].copy(), np.zeros(len(words), np.int64), np.full(len(words), -1)
        active, found = np.nonzero(end > pos)[0], []
        while len(active):
            here = pos[active]
            more = here < end[active]
            child = np.full(len(active), -1)
            child[more] = children(node[active[more]] << 8 | data[here[more]], -1)
            on, off = active[child >= 0], active[child < 0]
            node[on] = child[child >= 0]
            pos[on] += 1
            best = np.where(pos[on] == end[on], final[node[on]], inner[node[on]])
            some = on[best >= 0]
            token[some], reach[some] = best[best >= 0], pos[some]
            found.append((off, token[off]))
            pos[off], node[off] = reach[off], 0
            active = np.concatenate([on, off[reach[off] < end[off]]])
        if not found:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        word, tokens = (np.concatenate(x) for x in zip(*found))
        return tokens[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def encode_array(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all words (UTF-8, as they are after normalising), joined, and how many each has."""
        flat, lengths = self.proposed(words)
        word = np.repeat(np.arange(len(words)), lengths)
        bad = np.zeros(len(words), bool)
        bad[word[~self.selves(flat)]] = True
        inside = word[1:] == word[:-1]
        bad[word[1:][inside][~self.pairs(flat[:-1][inside] << 20 | flat[1:][inside])]] = True
        if not bad.any():
            return flat, lengths
        bounds, data = _bytes_of(words.filter(pa.array(bad)))
        inner, final = self._symbols
        symbols = inner[data]
        symbols[bounds[1:] - 1] = final[data[bounds[1:] - 1]]
        exact, n = self.merge_all(symbols, np.diff(bounds))
        out = lengths.copy()
        out[bad] = n
        joined = np.zeros(out.sum(), np.int64)
        merged = np.repeat(bad, out)
        joined[merged], joined[~merged] = exact, flat[~bad[word]]
        return joined, out

    @functools.cached_property
    def _symbols(self) -> tuple[np.ndarray, np.ndarray]:
        """The symbol of each byte inside a word and at its end."""
        return tuple(np.array([vocab[_BYTES[b]] for b in range(256)], np.int64) for vocab in (self.inner, self.final if self.suffix else self.inner))

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The same of byte-level strings."""
        byte = {c: b for b, c in _BYTES.items()}
        raw = pa.array([bytes(byte[c] for c in w) for w in words], pa.binary())
        flat, lengths = self.encode_array(raw)
        ends = np.cumsum(lengths).tolist()
        return [flat[x:y].tolist() for x, y in zip([0, *ends], ends)]

    def _encode_units(self, units: list[str]) -> list[bytes]:
        split = [self.pretokens(u) for u in units]
        words = list({w for ws in split for w in ws if isinstance(w, str)})
        ids = dict(zip(words, self.encode_words(words), strict=True))
        return [array("i", [i for w in ws for i in ((w,) if isinstance(w, int) else ids[w])]).tobytes() for ws in split]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, joined, and the bounds of each text."""
        units = Units.of(texts)
        return gather(*ids_of_units(units.dictionary, self.encode_array, self.unit_ids), units.codes, units.bounds)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """Token strings joined by one space, as the library does for a file without a decoder."""
        tokens = _string_array(tuple(self.strings)).take(pa.array(ids, pa.int32()))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), tokens), " ")


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the bytes of each string begin and end, and the bytes."""
    ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset).astype(np.int64) if len(words) else np.zeros(1, np.int64)
    return ends - ends[0], np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].astype(np.int64)


def _ranges(flat: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``flat[start[i]:stop[i]]`` for all i, joined, and their lengths."""
    n = stop - start
    return flat[np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())], n


@functools.cache
def _string_array(strings: tuple[str, ...]) -> pa.Array:
    return pa.array(strings, pa.string())


class _Table:
    """Integer keys from 0 on to numbers, by cuckoo hashing: a key is at one of two places, so many are found at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(63 - max(len(keys), 128).bit_length())
        size = 1 << 64 - int(self.shift)
        self.keys, self.values = np.full((2, size), -1, np.int64), np.zeros((2, size), np.int64)
        for attempt in range(1, 100):
            self.factors = [np.uint64(pow(f, attempt, 1 << 64) | 1) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
            held, left = np.full((2, size), -1, np.int64), np.arange(len(keys))
            for turn in range(200):
                if not len(left):
                    break
                side = turn % 2
                at = self._place(keys[left], side)
                before = held[side, at]
                held[side, at] = left  # of several for one place the last stays
                left = np.unique(np.concatenate([left[held[side, at] != left], before[before >= 0]]))
            if not len(left):
                break
        for side in (0, 1):
            full = held[side] >= 0
            self.keys[side, full], self.values[side, full] = keys[held[side, full]], values[held[side, full]]

    def _place(self, keys: np.ndarray, side: int) -> np.ndarray:
        return ((keys.view(np.uint64) * self.factors[side]) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray, none: int) -> np.ndarray:
        one, two = self._place(keys, 0), self._place(keys, 1)
        out = np.where(self.keys[0, one] == keys, self.values[0, one], none)
        return np.where(self.keys[1, two] == keys, self.values[1, two], out)


class _Flags:
    """A boolean for each integer key, tested once and looked up with a binary search over all keys at once."""

    def __init__(self, test: Callable[[np.ndarray], np.ndarray], limit: int = 4_000_000):
        self.test, self.limit = test, limit
        self.keys, self.flags = np.zeros(0, np.int64), np.zeros(0, bool)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        distinct, back = np.unique(keys, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == distinct
        found = np.zeros(len(distinct), bool)
        found[known] = self.flags[at[known]]
        if not known.all():
            new = distinct[~known]
            found[~known] = self.test(new)
            if len(self.keys) + len(new) > self.limit:
                self.keys, self.flags = new, found[~known]
            else:
                order = np.argsort(keys := np.concatenate([self.keys, new]), kind="stable")
                self.keys, self.flags = keys[order], np.concatenate([self.flags, found[~known]])[order]
        return found[back]


@functools.cache
def word_bpe(path: str) -> WordBpe:
    """One per worker process."""
    return WordBpe(path)


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with a column of token ids; a column that already has that name is replaced."""
    arrow_batches(df.sparkSession)
    keep = [f for f in df.schema.fields if f.name != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            for b in pieces(batch, text):
                flat, bounds = bpe.encode(b.column(text))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in keep), lists], names=[*(f.name for f in keep), ids])
        release_memory()

    return df.mapInArrow(run, T.StructType([*keep, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the texts that its token ids stand for; null ids count as none."""
    arrow_batches(df.sparkSession)
    keep = [f for f in df.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for b in batches:
            lists = b.column(ids)
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], np.cumsum(lengths)])
            texts = bpe.decode(lists.flatten().to_numpy(zero_copy_only=False), bounds)
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in keep), texts], names=[*(f.name for f in keep), text])

    return df.mapInArrow(run, T.StructType([*keep, T.StructField(text, T.StringType())]))


def round_trip(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Encode, decode, and report per row the number of ids and the SHA-256 of ids and of the decoded text.

    Columns: ``keep``, n_tokens long, ids_sha256 string (ids as little-endian unsigned 32-bit integers), decoded_sha256.
    """
    import hashlib

    arrow_batches(df.sparkSession)
    df = df.select(*keep, text)
    fields = [df.schema[k] for k in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            for b in pieces(batch, text, 2 << 20):
                flat, bounds = bpe.encode(b.column(text))
                data, ends = memoryview(flat.astype("<u4").tobytes()), bounds.tolist()
                out = bpe.decode(flat, bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(b.column(k) for k in keep),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array([hashlib.sha256(data[4 * x : 4 * y]).hexdigest() for x, y in zip(ends, ends[1:])]),
                        pa.array([hashlib.sha256(s.as_buffer()).hexdigest() for s in out.cast(pa.binary())]),
                    ],
                    names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        release_memory()

    schema = [*fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return df.mapInArrow(run, T.StructType(schema))


__all__ = ["WordBpe", "decode", "encode", "round_trip", "tokenizer_file", "word_bpe"]
