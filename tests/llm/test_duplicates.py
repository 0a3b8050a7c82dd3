"""Cuckoo index, exact duplicates, trie join, components, near-duplicates."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from helpers import ODD, SCHEMA, edited, frame, prose
from pyspark.sql import functions as F

from leafstack.llm import cuckoo_dedup, near_duplicates, simhash
from leafstack.llm._common import inside, outside, written
from leafstack.llm._units import hashes, mixed, word_of, words
from leafstack.llm.components import Forest, components, spanning
from leafstack.llm.queries import QUERIES


def digest(k):
    return hashlib.sha256(str(k).encode()).digest()


def test_index_inserts_deletes_and_grows():
    index, live, r = cuckoo_dedup.CuckooIndex(4), {}, random.Random(1)
    for step in range(20_000):
        k = r.randrange(3000)
        if k in live and r.random() < 0.5:
            assert index.delete(digest(k))
            del live[k]
        elif k not in live:
            index.insert(digest(k), step)
            live[k] = step
        if step % 500 == 0:
            assert len(index) == len(live) and all(index.get(digest(k)) == live.get(k) for k in range(3000))
    assert index.resizes and not index.delete(digest("never"))
    assert dict(index.items()) == {digest(k): v for k, v in live.items()}


def test_marks_that_clash_are_told_apart():
    index = cuckoo_dedup.CuckooIndex(2)
    same = [bytes([7, 7, 0, 0]) + bytes(8) + bytes([i]) * 20 for i in range(30)]
    for i, d in enumerate(same):
        assert index.get(d) is None
        index.insert(d, i)
        if index.buckets > 1 << 14:
            pytest.skip("one bucket pair cannot hold this many equal marks")
        if i == 7:
            break
    assert [index.get(d) for d in same[:8]] == list(range(8)) and index.get(same[9]) is None


def slow_groups(rows):
    groups = {}
    for i, t in rows:
        bare = "".join(c for c in (t or "") if c not in " \t\n\v\f\r")
        groups.setdefault(bare, []).append((-len(t or ""), i))
    return {i: (min(g)[1], len(g), hashlib.sha256(b.encode()).hexdigest()) for b, g in groups.items() for _, i in g}


def test_exact_duplicates(spark):
    texts = [*ODD, "a b", "ab", "a  b", " a b", "ab", *[prose(1)] * 40, prose(1) + " ", prose(2)]
    out = {r.doc_id: r for r in cuckoo_dedup.exact_duplicates(frame(spark, texts, extra=True)).collect()}
    want = slow_groups(enumerate(texts))
    assert {i: (r.keep_id, r.group_size, r.text_sha256) for i, r in out.items()} == want
    assert all(r.kept == (r.keep_id == i) for i, r in out.items())
    kept = cuckoo_dedup.without_copies(frame(spark, texts, extra=True))
    assert {r.doc_id for r in kept.collect()} == {w[0] for w in want.values()} and "digest" in kept.columns


def test_exact_duplicates_of_odd_tables(spark):
    assert cuckoo_dedup.exact_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "t", None, None, None), (3, "t", None, None, None), (None, "u", None, None, None), (4, "v", None, None, None), (4, "v", None, None, None)]
    out = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in cuckoo_dedup.exact_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert out == sorted([("None", "3", 2, False), ("3", "3", 2, True), ("None", "None", 1, True), ("4", "4", 2, True), ("4", "4", 2, True)])


def test_bounded_indexes_lose_nothing(spark):
    found = cuckoo_dedup.digests(frame(spark, [prose(k % 37, 20) for k in range(400)]))
    rows = cuckoo_dedup.groups(found, bound=5, bucket_rows=7).collect()
    assert len(rows) == 37 and sum(r.n for r in rows) == 400 and {r.ident for r in rows} == set(range(37))


def slow_fingerprint(text, n=3):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(nodes, linked):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


def test_fingerprints_and_components(spark):
    base = prose(7, 400)
    texts = [*ODD, "A b", "a B", "one", *(edited(base, k, 2) for k in range(60)), *(prose(k, 50) for k in range(60))]
    out = {r.doc_id: r for r in simhash.linked_classes(frame(spark, texts, extra=True)).collect()}
    fps = {i: slow_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: r.fp % (1 << 64) for i, r in out.items()} == fps
    assert {i: r.component for i, r in out.items()} == slow_components(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert simhash.linked_classes(spark.createDataFrame([], SCHEMA)).count() == 0
    lone = simhash.linked_classes(spark.createDataFrame([(None, "x y z", None, None, None), (2, "x y z", None, None, None)], SCHEMA))
    assert {r.component for r in lone.collect()} == {2}


@pytest.mark.parametrize(("budget", "largest"), [(2, 2000), (2, 20), (4, 60)])
def test_trie_join_finds_every_pair(spark, budget, largest):
    rng = np.random.default_rng(budget)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, k).astype(np.uint64)) for b in base for k in (1, 2, 3, 5)]
    star = [base[0] ^ (np.uint64(1) << np.uint64(k)) for k in range(64)]
    values = np.unique(np.array([*base, *near, *star], np.uint64))
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(values.view(np.int64))], "id long, fp long").repartition(3)
    units = simhash.dealt(simhash.unit_rows(df, "fp", budget, budget + 1), budget, largest)
    assert units.count() < 400 * len(values)
    found = set()
    for _, rows in units.toPandas().groupby("unit"):
        rows = rows.assign(v=rows.fp_key.to_numpy().view(np.uint64)).sort_values(["side", "v"])
        v, ids = rows.v.to_numpy(), rows.id.to_numpy()
        for i, j, _ in simhash.walk(v, simhash.unit_frontier(rows.unit.to_numpy(), rows.side.to_numpy()), budget):
            found |= {(min(a, b), max(a, b)) for a, b in zip(ids[i].tolist(), ids[j].tolist())}
    bits = np.bitwise_count(values[:, None] ^ values[None, :])
    assert found == {(i, j) for i, j in zip(*np.nonzero(bits <= budget)) if i < j}


def test_components_of_links(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(100, 160)] + [(500, 500 + k) for k in range(1, 80)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)] + [(7, 7), (3, None)]
    out = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = {(a, b) for a, b in links if b is not None and a != b}
    nodes = sorted({x for p in real for x in p})
    assert out == slow_components(nodes, lambda a, b: (a, b) in real or (b, a) in real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_spanning_forests():
    rng = np.random.default_rng(0)
    i, j, w = rng.integers(0, 200, 3000), rng.integers(0, 200, 3000), rng.integers(0, 9, 3000)
    order, root, total = np.argsort(w, kind="stable"), list(range(200)), 0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k in order:
        a, b = find(i[k]), find(j[k])
        if a != b:
            root[a] = b
            total += w[k]
    at = spanning(i, j, w, 200)
    assert w[at].sum() == total and len(at) == 199
    forest = Forest(200, depth=3)
    for k in range(0, 3000, 500):
        forest.add(i[k : k + 500], j[k : k + 500], w[k : k + 500])
    assert len(forest.i) <= 3 * 199 and np.sort(forest.level)[:199].sum() <= total


def test_near_duplicates(spark):
    base = [prose(k, 150) for k in range(12)]
    texts = [*ODD, *base, *(edited(b, 50 + k, 2) for k, b in enumerate(base)), *(b.upper().replace(" ", ", ") for b in base), *(edited(b, 90 + k, 60) for k, b in enumerate(base))]
    out = {r.doc_id: r.class_id for r in near_duplicates.near_duplicate_classes(frame(spark, texts, extra=True)).collect()}
    import re

    bags = []
    for t in texts:
        words = [w for w in (re.sub(r"^[\W_]+|[\W_]+$", "", u) for u in (t or "").lower().split()) if w]
        bags.append((tuple(words), {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()))

    def linked(a, b):
        x, y = bags[a], bags[b]
        return x[0] == y[0] or bool(x[1]) and len(x[1] & y[1]) >= 0.8 * len(x[1] | y[1])

    assert out == slow_components(list(range(len(texts))), linked)
    one = near_duplicates.one_of_each(frame(spark, texts, extra=True))
    assert {r.doc_id for r in one.collect()} == set(out.values()) and "fp" in one.columns
    assert near_duplicates.near_duplicate_classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_near_duplicates_in_one_large_group(spark):
    base = prose(3, 300)
    texts = [edited(base, k, 3) for k in range(300)] + [base] + [prose(k, 80) for k in range(100, 160)]
    out = {r.doc_id: r.class_id for r in near_duplicates.near_duplicate_classes(frame(spark, texts)).collect()}
    assert {out[i] for i in range(301)} == {0} and all(out[i] == i for i in range(301, len(texts)))


def test_truncated_and_extended_copies(spark):
    """Near copies that miss or gain a passage, at a similarity of 0.8 to 0.9, whose words' fingerprints differ in many bits."""
    base = [prose(k, 120 + 10 * k) for k in range(40)]
    cut = [" ".join(w[: len(w) - int((len(w) - 4) * (0.19 if k % 2 else 0.12))]) for k, w in enumerate(b.split() for b in base)]
    longer = [b + " " + prose(900 + k, int(0.22 * (len(b.split()) - 4))) for k, b in enumerate(base)]
    for other in (cut, longer):
        out = {r.doc_id: r.class_id for r in near_duplicates.near_duplicate_classes(frame(spark, [*base, *other])).collect()}
        assert out == {i: i % 40 for i in range(80)}


def test_texts_of_the_same_words(spark):
    """Sentences in another order give equal fingerprints in all tables, so words do not tell which pairs are near."""
    sentences = [prose(k, 9) for k in range(40)]
    orders = [random.Random(k).sample(sentences, 40) for k in range(150)]
    turned = [o[:-2] + o[-1:] + o[-2:-1] for o in orders]
    texts = [" ".join(o) for o in [*orders, *turned]]
    out = {r.doc_id: r.class_id for r in near_duplicates.near_duplicate_classes(frame(spark, texts)).collect()}
    assert out == {i: i % 150 for i in range(300)}


def test_pairs_that_no_fingerprint_meets(spark):
    """A passage of new words after a text of few distinct ones: similar by shingles, far apart by words."""
    base = [prose(k, 600, 60) for k in range(10)]
    texts = [*base, *(f"{b} {prose(500 + k, 100)}" for k, b in enumerate(base))]
    words, bounds = near_duplicates.word_hashes(pa.array(texts))
    own = [np.unique(words[x:y]) for x, y in zip(bounds, bounds[1:])]
    for i in range(10):
        bits = [(simhash.majority(mixed(own[i], seed)) ^ simhash.majority(mixed(own[i + 10], seed))).bit_count() for seed in near_duplicates._SEEDS[:2]]
        assert min(bits) > 4
    out = {r.doc_id: r.class_id for r in near_duplicates.near_duplicate_classes(frame(spark, texts)).collect()}
    assert out == {i: i % 10 for i in range(20)}


@pytest.mark.parametrize("settings", [{}, {"dense": 3, "chunk": 4000}, {"tables": 1, "budget": 1, "dense": 0, "chunk": 1}])
def test_every_pair_of_a_dense_group(spark, settings, monkeypatch):
    """Copies with many edits, of which some pairs reach the similarity and most do not: as many classes as brute force has."""
    base, other = prose(3, 120), prose(4, 120)
    texts = [edited(base, k, 1 + k % 3) for k in range(130)] + [edited(other, k, 2) for k in range(40)] + [f"{base} {prose(k, 40)}" for k in range(20)]
    flat, bounds = near_duplicates.word_hashes(pa.array(texts))
    sets = [set(s.tolist()) for s in near_duplicates.shingle_sets(flat, bounds, 5)]
    want = slow_components(list(range(len(texts))), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    pairs = sum(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a in range(len(sets)) for b in range(a))
    assert pairs > 1000 and 3 < len(set(want.values())) < 100
    monkeypatch.setattr(near_duplicates, "CROWDED", (1, 4))
    out = {r.doc_id: r.class_id for r in near_duplicates.near_duplicate_classes(frame(spark, texts), **settings).collect()}
    assert out == want


@pytest.mark.parametrize("hub", [None, 3])
def test_meeting_against_all_pairs(hub):
    r = np.random.default_rng(7)
    n, s = 300, 0.8
    size = r.integers(1, 60, n)
    rows = {"unit": r.integers(0, 12, n), "node": np.arange(n), "root": r.integers(0, 6, n), "size": size, "tail": np.maximum(1, (size * r.uniform(0.7, 1, n)).astype(np.int64))}

    def wanted(i, j):
        if rows["unit"][i] != rows["unit"][j] or rows["root"][i] == rows["root"][j]:
            return False
        return min(rows["tail"][i], rows["tail"][j]) >= s / (1 + s) * (size[i] + size[j]) - 1e-6

    want = {(i, j) for i in range(n) for j in range(i + 1, n) if wanted(i, j)}
    m = near_duplicates.Meeting(rows, s, hub)
    found = [tuple(sorted((m.rows["node"][x], m.rows["node"][y]))) for i, j in m.pairs() for x, y in zip(i, j)]
    assert len(found) == len(set(found)) and set(found) == want
    crowded = set(m.crowded(0, 15).tolist())
    left = {tuple(sorted((m.rows["node"][x], m.rows["node"][y]))) for i, j in m.pairs() for x, y in zip(i, j)}
    assert crowded and left == {(i, j) for i, j in want if rows["unit"][i] not in crowded}
    if hub is not None:
        only = near_duplicates.Meeting(rows, s, hub, others=False)
        some = {tuple(sorted((only.rows["node"][x], only.rows["node"][y]))) for i, j in only.pairs() for x, y in zip(i, j)}
        assert some == {(i, j) for i, j in want if hub in (rows["root"][i], rows["root"][j])}


def test_sketches_rule_out_no_similar_pair():
    r = np.random.default_rng(1)
    sets = []
    for k in range(60):
        base = r.integers(0, 2**63, 5 + 9 * k, dtype=np.uint64)
        for drop in (0, 0.02, 0.05, 0.1, 0.2, 0.5):
            keep = base[r.random(len(base)) >= drop]
            sets.append(np.unique(np.concatenate([keep, r.integers(0, 2**63, int(len(base) * drop / 2), dtype=np.uint64)])))
    size = np.array([len(s) for s in sets])
    sketches = near_duplicates.Sketches(size, np.frombuffer(b"".join(map(near_duplicates.parity_sketch, sets)), "<u8"))
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    take = (i < j) & (np.minimum(size[i], size[j]) >= 0.8 * np.maximum(size[i], size[j]))
    i, j = i[take], j[take]
    near = sketches.near(i, j, 0.8)
    both = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)])
    similar = both >= 0.8 * (size[i] + size[j] - both)
    assert similar.sum() > 100 and near[similar].all() and near[~similar].mean() < 0.1


def test_filters_go_by_row(spark):
    """Rows that repeat an id with another text, rows without an id, and rows that are there twice."""
    rows = [(1, "aaa bbb"), (2, "ccc ddd"), (2, "aaabbb"), (None, "zz"), (None, "zz"), (None, "aaa  bbb"), (5, "q r"), (5, "q r"), (5, "q  r"), (None, "y"), (7, None), (8, " ")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)
    out = sorted((str(r.doc_id), r.text) for r in cuckoo_dedup.without_copies(df).collect())
    assert out == sorted([("None", "aaa  bbb"), ("2", "ccc ddd"), ("None", "zz"), ("5", "q  r"), ("None", "y"), ("8", " ")])
    text = prose(1, 40)
    rows = [(1, text), (2, prose(2, 40)), (2, text.upper()), (None, text + "!"), (None, prose(3, 40)), (None, prose(3, 40)), (9, prose(4, 40)), (9, prose(4, 40)), (9, prose(5, 40)), (10, ""), (11, None)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)
    out = sorted((str(r.doc_id), r.text) for r in near_duplicates.one_of_each(df).collect())
    assert out == sorted([("1", text), ("2", prose(2, 40)), ("None", prose(3, 40)), ("9", prose(4, 40)), ("9", prose(5, 40)), ("10", "")])
    empty = spark.createDataFrame([], SCHEMA)
    assert cuckoo_dedup.without_copies(empty).count() == near_duplicates.one_of_each(empty).count() == 0


def test_bitmap_filters_are_exact(spark):
    df = spark.createDataFrame([(i,) for i in range(3000)] + [(None,), (None,)], "doc_id long")
    ids = written(spark.createDataFrame([(i,) for i in range(0, 5000, 7)], "doc_id long"), "ids")
    assert {r.doc_id for r in inside(df, ids, "doc_id").collect()} == set(range(0, 3000, 7))
    assert sorted(str(r.doc_id) for r in outside(df, ids, "doc_id").collect()) == sorted([str(i) for i in range(3000) if i % 7] + ["None"] * 2)


def test_near_duplicates_of_a_table(spark, data):
    """All pairs of the table by brute force, with every third text once more, cut short or with a new end."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    extra = []
    for k, (d, t) in enumerate(sorted(texts.items())):
        words = t.split()
        if k % 3 == 0:
            extra.append((10_000 + d, " ".join(words[: len(words) - len(words) // (6 if k % 2 else 4)])))
        if k % 3 == 1:
            extra.append((20_000 + d, t + " " + prose(k, len(words) // (7 if k % 2 else 4))))
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    texts |= dict(extra)
    bags = {}
    for d, t in texts.items():
        ws = [w for u in t.split() if (w := word_of(u))]
        bags[d] = tuple(ws), {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()

    def linked(a, b):
        x, y = bags[a], bags[b]
        return x[0] == y[0] or (bool(x[1]) and min(len(x[1]), len(y[1])) >= 0.8 * max(len(x[1]), len(y[1])) and len(x[1] & y[1]) >= 0.8 * len(x[1] | y[1]))

    want = slow_components(sorted(bags), linked)
    assert {r.doc_id: r.class_id for r in near_duplicates.near_duplicate_classes(df).collect()} == want
    assert len(want) - len(set(want.values())) > 40


def test_op6_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    fps = {r.doc_id: slow_fingerprint(r.text) for r in docs}
    out = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op6_simhash_trie_join"](spark, data).collect()}
    want = slow_components(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert out == {d: (f"{fps[d]:016x}", want[d]) for d in fps}


def test_words_and_hashes_of_units():
    r = random.Random(3)
    units = [*ODD[3].split(), "İx", "ΣΑΣ", "“quoted”", "l’été", "_a_", "\x01b\x7f", "x" * 5000, "y" * 2000, "é!", "", *("z" * r.randint(1, 60) + str(k) for k in range(6000))]
    for part in (pa.array(units, pa.string()), pa.array(units, pa.string()).slice(5, 40), pa.array([], pa.string())):
        assert words(part).to_pylist() == [word_of(u) for u in part.to_pylist()]
    known = dict(zip(units, hashes(pa.array(units)).tolist()))
    assert len(set(known.values())) == len(known)
    for k in range(0, len(units), 997):
        assert hashes(pa.array(units[k:])).tolist() == [known[u] for u in units[k:]]
