"""Token counts, speculative BPE and grammar blocks against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from helpers import ODD, SCHEMA, frame, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from leafstack.llm import repair_grammar, speculative_bpe, token_counts
from leafstack.llm._units import Units
from leafstack.llm.queries import QUERIES

PATH = speculative_bpe.tokenizer_file("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ROOT = Path(__file__).resolve().parents[2]
TEXTS = [*ODD, *(prose(k) for k in range(20)), prose(1), prose(99, 30_000)]


def wanted(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, TEXTS, extra=True)


def test_encode_and_decode(docs):
    ids = {r.doc_id: r.ids for r in speculative_bpe.encode(docs, PATH).collect()}
    assert ids == {i: wanted(t) for i, t in enumerate(TEXTS)}
    texts = {r.doc_id: r.decoded for r in speculative_bpe.decode(speculative_bpe.encode(docs, PATH), PATH).collect()}
    assert texts == {i: TOKENIZER.decode(x, skip_special_tokens=False) for i, x in ids.items()}


def test_round_trip_digests(docs):
    for r in speculative_bpe.round_trip(docs, PATH, keep=("doc_id",)).collect():
        ids = wanted(TEXTS[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(TOKENIZER.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_counts(docs):
    out = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, PATH, limit=100).collect()}
    assert out == {i: (len((t or "").encode()), len(wanted(t)), len(wanted(t)) > 100) for i, t in enumerate(TEXTS)}


@given(st.text(st.sampled_from("abdehimnorst' .,!1Éßñ<|>\t"), max_size=60), st.integers(1, 20))
@settings(max_examples=200, deadline=None)
def test_chunks_do_not_matter(text, chunk):
    n = len(wanted(text))
    assert token_counts.token_counter(PATH).count(pa.array([text]), chunk).tolist() == [n]
    assert len(speculative_bpe.word_bpe(PATH).encode(pa.array([text]))[0]) == n


def test_prefix_scan_is_a_scan():
    assert token_counts.prefix_scan(list("abcdefg"), lambda a, b: a + b) == ["abcdefg"[: k + 1] for k in range(7)]
    assert token_counts.prefix_scan([], lambda a, b: a) == []


def test_maps_compose_in_any_grouping():
    """The maps of a word's chunks give its count from a scan, from the left and from the right, cleared machine or not."""
    counter, r = token_counts.TokenCounter(PATH), random.Random(8)
    for word in ("a" * 3000, "".join(r.choices("etaoinshr", k=4000)), "ab" * 900 + "".join(r.choices("thern", k=300))):
        maps = counter.word_maps(word, 37)
        want = len(counter.bpe.merged(counter.bpe.symbols(word)))
        assert token_counts.prefix_scan(maps, token_counts.composed)[-1](token_counts.FRESH) == (token_counts.FRESH, want)
        right = maps[-1]
        for m in maps[-2::-1]:
            right = token_counts.composed(m, right)
        assert right(token_counts.FRESH)[1] == want
        counter.machine.limit = 10
        assert token_counts.prefix_scan(counter.word_maps(word, 64), token_counts.composed)[-1](token_counts.FRESH)[1] == want
        counter.machine.limit = 300_000


def test_a_long_text_without_white_space_takes_little_memory():
    code = f"""
import resource, sys
sys.path.insert(0, {str(ROOT)!r})
import pyarrow as pa
from leafstack.llm import token_counts
counter = token_counts.token_counter({PATH!r})
counter.count(pa.array(["a b"]))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert counter.count(pa.array(["abcde" * 3_200_000])).tolist()[0] > 0
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(out.stdout) < 300  # 16 MB of one word


def test_machine_starts_anew_when_full():
    bpe = speculative_bpe.word_bpe(PATH)
    small, words = token_counts.CountTransducer(bpe, limit=50), prose(5, 300).split()
    assert [small.count(w) for w in words] == [len(bpe.merged(bpe.symbols(w))) for w in words]
    assert len(small.states) < 200


def test_speculation_equals_merging():
    bpe, r = speculative_bpe.word_bpe(PATH), random.Random(4)
    words = ["".join(r.choices("etaoinshrdlu", k=r.randint(1, 60))) for _ in range(2000)]
    merged = [bpe.merged(bpe.symbols(w)) for w in words]
    assert bpe.encode_words(words) == merged
    flat, lengths = bpe.proposed(pa.array(words))
    greedy = [x.tolist() for x in np.split(flat, np.cumsum(lengths)[:-1])]
    assert 0 < sum(a == b for a, b in zip(greedy, merged)) < len(words)
    vocab = [{s for s in bpe.inner}, {s for s in bpe.final}]
    for w, tokens in zip(words[:300], greedy):
        i = 0
        for t in tokens:
            n = max(n for n in range(1, len(w) - i + 1) if w[i : i + n] in vocab[i + n == len(w)])
            assert t == (bpe.final if i + n == len(w) else bpe.inner)[w[i : i + n]]
            i += n


def test_merging_together_equals_merging_alone(monkeypatch):
    bpe, r = speculative_bpe.WordBpe(PATH), random.Random(9)
    words = ["".join(r.choices("aabthero" if k % 2 else "etaoinshrdlu'", k=r.randint(1, 90))) for k in range(1500)] + ["a" * k for k in range(1, 60)]
    merged = [bpe.merged(bpe.symbols(w)) for w in words]
    for most in (10_000, 48, 0):
        monkeypatch.setattr(bpe, "AT_ONCE", most)
        flat, n = bpe.merge_all(np.array([x for w in words for x in bpe.symbols(w)]), np.array([len(w) for w in words]))
        assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == merged
    assert bpe.merge_all(np.zeros(0, np.int64), np.zeros(0, np.int64))[0].tolist() == []


def test_tables_find_their_keys():
    r = np.random.default_rng(0)
    for n in (0, 1, 50, 60_000):
        keys = np.unique(r.integers(0, 1 << 40, n))
        table = speculative_bpe._Table(keys, np.arange(len(keys)) * 3)
        assert (table(keys, -1) == np.arange(len(keys)) * 3).all()
        other = np.setdiff1d(r.integers(0, 1 << 40, 1000), keys)
        assert (table(other, -1) == -1).all()


def test_blocks(spark, docs):
    blocks = repair_grammar.encode_blocks(docs, PATH, shard_bytes=4000)
    rows = sorted(blocks.collect(), key=lambda r: (r.part, r.shard))
    assert len(rows) > 3 and [i for r in rows for i in r.doc_ids] == list(range(len(TEXTS)))
    every = [wanted(t) + [2] for t in TEXTS]
    for r in rows:
        g = repair_grammar.Grammar.from_bytes(bytes(r.payload))
        own = [every[i] for i in r.doc_ids]
        assert [g.document(k).tolist() for k in range(len(own))] == own
        flat = [x for ids in own for x in ids]
        assert g.n_ids == len(flat) == sum(r.n_ids) and g.ids(len(flat) // 3, len(flat) // 2).tolist() == flat[len(flat) // 3 : len(flat) // 2]
    start = 0
    for r, ids in zip(repair_grammar.write_and_read(docs, PATH).orderBy("doc_id").collect(), every):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_frequent_pairs_become_rules():
    library = repair_grammar._library(PATH)
    units = Units.of(pa.array([prose(1, 50, 40) + " one two three"] * 300))
    g = repair_grammar.Grammar.of(units, *library.rows(units.dictionary), library.above, 2)
    assert len(g.rules) and len(g.symbols) < 0.6 * g.n_ids
    with pytest.raises(ValueError):
        repair_grammar.Grammar.from_bytes(b"nope" + g.to_bytes()[4:])


def test_rules_are_made_until_none_is_worth_it():
    library = repair_grammar._library(PATH)
    copies, rest = [prose(3, 400)] * 60, [prose(k, 300) for k in range(10, 40)]
    texts = [t for pair in zip(copies, rest * 2) for t in pair]
    units = Units.of(pa.array(texts))
    flat, lengths = library.rows(units.dictionary)
    g = repair_grammar.Grammar.of(units, flat, lengths, library.above, 2)
    g = repair_grammar.Grammar.from_bytes(g.to_bytes())
    every = [wanted(t) + [2] for t in texts]
    assert [g.document(k).tolist() for k in range(len(texts))] == every and g.decode()[0].tolist() == sum(every, [])
    starts = np.concatenate([[0], g.ends[:-1]])
    assert max((g.ends - starts)[::2]) <= 12  # a text of 400 words that occurs 60 times is folded whole
    seen, taken = {}, {}
    for x, y in zip(starts, g.ends - 1):
        for k in range(x, y - 1):
            pair = (g.symbols[k], g.symbols[k + 1])
            if taken.get(pair) != k:  # a run of one symbol holds overlapping pairs
                seen[pair], taken[pair] = seen.get(pair, 0) + 1, k + 1
    assert max(seen.values()) < 5


def test_shards_are_clearly_smaller_than_plain_ids(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = repair_grammar.encode_blocks(docs, PATH).selectExpr("octet_length(payload) AS bytes", "aggregate(n_ids, 0L, (x, y) -> x + y) AS n").groupBy().sum().first()
    assert r[0] / r[1] < 1.3  # 16 bits an id are 2


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert speculative_bpe.round_trip(empty, PATH, keep=("doc_id",)).count() == token_counts.count_tokens(empty, PATH).count() == 0
    assert repair_grammar.write_and_read(empty, PATH).count() == 0
    odd = spark.createDataFrame([(None, "x", None, None, None), (5, None, None, None, None), (5, "y", None, None, None)], SCHEMA)
    assert [(r.doc_id, r.n_tokens) for r in repair_grammar.write_and_read(odd, PATH).orderBy("start").collect()][0] == (None, 2)
    assert token_counts.count_tokens(odd, PATH).count() == 3


@pytest.mark.parametrize("name", ["op4_transducer_token_counts", "op9_speculative_bpe", "op10_repair_token_blocks"])
def test_queries(spark, data, name):
    docs = {r.doc_id: wanted(r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    extra = [2] if name.startswith("op10") else []
    rows = {r.doc_id: r for r in QUERIES[name](spark, data).collect()}
    assert {d: r.n_tokens for d, r in rows.items()} == {d: len(x + extra) for d, x in docs.items()}
    if extra:
        start = 0
        for d in sorted(docs):
            assert (rows[d].start, rows[d].ids_crc32) == (start, zlib.crc32(np.array(docs[d] + extra, "<u4").tobytes()))
            start += rows[d].n_tokens
