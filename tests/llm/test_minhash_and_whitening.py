from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from helpers import ODD, edited, frame, prose
from pyspark.sql import functions as F

from leafstack.llm import odd_sketches as odd
from leafstack.llm import whitening as wh
from leafstack.llm.queries import QUERIES

# ---------------------------------------------------------------- op12


def sets_of(texts, n=5):
    out = []
    for t in texts:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower) if w]
        out.append({tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set())
    return out


def classes(ids, sets, percent=85):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(ids)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


def check(spark, texts, **options):
    found = {r.doc_id: r for r in odd.near_duplicates(frame(spark, texts, extra=True), **options).collect()}
    sets = sets_of(texts)
    expected = classes(list(range(len(texts))), sets, options.get("percent", 85))
    assert len(found) == len(texts)
    assert [found[i].component_id for i in range(len(texts))] == expected
    assert [found[i].n_shingles for i in range(len(texts))] == list(map(len, sets))
    assert [found[i].kept for i in range(len(texts))] == [c == i for i, c in enumerate(expected)]
    return expected


def family(seed, words=120):
    """A text with copies that are changed, cut, extended, in other case and spacing, around and beyond the similarity."""
    base = prose(seed, words)
    out = [base, base.upper(), base.replace(" ", " \t "), f"\n{base} "]
    out += [edited(base, seed + k, k) for k in range(1, 7)]
    out += [" ".join(base.split()[: words - k]) for k in (1, 9, 17, 18, 19, 30)]
    out += [f"{base} {prose(seed + 1, k)}" for k in (3, 15, 20, 21, 22, 40)]
    return out


def test_classes_equal_brute_force(spark):
    texts = [t for seed in range(6) for t in family(100 * seed, 40 + 25 * seed)]
    texts += [prose(1000 + k, 30) for k in range(20)] + ["one two three", "ONE  two three", "one two", "a b c d e", "a b c d e f"] + ODD + ODD
    random.Random(5).shuffle(texts)
    found = check(spark, texts)
    assert len(set(found)) < len(found) - 40


def test_units_that_are_split_give_the_same(spark):
    base = prose(7, 150)
    texts = [edited(base, k, random.Random(k).choice((2, 3, 5))) for k in range(70)] + [base]
    assert check(spark, texts, large=7) == check(spark, texts)


@pytest.mark.parametrize("percent", [60, 100])
def test_other_similarities(spark, percent):
    check(spark, [t for seed in (3, 900) for t in family(seed, 60)], percent=percent)


def test_repeated_null_and_absent_rows(spark):
    text, near = prose(1, 100), prose(1, 100) + " more"
    rows = [(5, text), (5, text), (5, "quite another text with words enough"), (None, text), (None, "alone and without an id here"), (2, near), (9, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id, r.kept, r.n_shingles) for r in odd.near_duplicates(df).collect() if r.component_id is not None)
    assert found == [(-1, 2, False, 96), (2, 2, True, 97), (5, 2, False, 96), (5, 2, False, 96), (5, 5, True, 2), (8, 8, True, 0), (9, 9, True, 0)]
    assert odd.near_duplicates(df.limit(0)).count() == 0
    alone = odd.near_duplicates(df).where("component_id IS NULL").collect()
    assert [(r.doc_id, r.kept) for r in alone] == [(None, True)]


def test_a_long_text_and_its_copy(spark):
    text = prose(3, 60_000, 20_000)
    assert check(spark, [text, edited(text, 1, 300), edited(text, 2, 9000), "x" * 300_000]) == [0, 0, 2, 3]


def test_sketches_estimate_the_similarity_and_rule_out_no_similar_pair():
    draw, errors, most = np.random.default_rng(1), [], odd.most_bits(0.85)
    for size in (20, 400, 5000):
        for share in (0.86, 0.9, 0.97):
            for _ in range(20):
                common = int(2 * size * share / (1 + share))
                h = draw.integers(0, 1 << 64, 2 * size - common, np.uint64)
                real = common / (2 * size - common)
                values = np.stack([odd.samples(np.sort(h[:size])), odd.samples(np.sort(h[size - common :]))])
                one, two = odd.odd_sketches(values)
                bits = int(np.bitwise_count(one ^ two).sum())
                errors.append(float(odd.similarity_of(bits)) - real)
                assert real < 0.85 or bits <= most
                assert real < 0.85 or (odd.band_keys(values)[0] == odd.band_keys(values)[1]).any()
    assert abs(np.mean(errors)) < 0.005 and np.std(errors) < 0.025


def test_most_bits_is_the_tail_of_thrown_samples():
    draw, counts = np.random.default_rng(2), []
    for _ in range(4000):
        differing = draw.binomial(64, 0.15)
        counts.append((np.bincount(draw.integers(0, 128, 2 * differing), minlength=128) & 1).sum())
    assert abs(odd.most_bits(0.85, 64, 128, miss=0.01) - np.quantile(counts, 0.99)) <= 1
    assert odd.most_bits(1.0) == 0


def test_shingles_follow_ascii_case_and_space():
    one, two = odd.shingles(pa.array(["Ä B\x0bc D e", "Ä b\x0cC d E"]), 5), odd.shingles(pa.array(["ä b c d e"]), 5)
    assert np.array_equal(one[0], one[1]) and not np.array_equal(one[0], two[0])


def test_op12_query_equals_brute_force(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    found = {r.doc_id: r.component_id for r in QUERIES["op12_odd_sketch_minhash"](spark, data).collect()}
    ids = sorted(docs)
    assert [found[i] for i in ids] == classes(ids, sets_of([docs[i] for i in ids]))


# ---------------------------------------------------------------- op11


def reference(vectors, k):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    c = x - sums / n
    values, turn = np.linalg.eigh(c.T @ c / n)
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    return x, n, sums, values, turn, np.square(n * x - sums).sum(axis=1), np.square(c).sum() / n


def table(spark, vectors, extra=()):
    rows = [(i, v) for i, v in enumerate(vectors)] + list(extra)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    return df.withColumn("x", F.lit("clash")).withColumn("whitened", F.lit("clash")).withColumn("component", F.lit("clash"))


def spectrum(rows, scales, seed=1):
    draw = np.random.default_rng(seed)
    turn = np.linalg.qr(draw.standard_normal((len(scales), len(scales))))[0]
    return (draw.standard_normal((rows, len(scales))) * scales @ turn).astype(np.float32).tolist()


BAD = [(900, None), (901, [None] * 12), (902, [float("nan")] + [0.0] * 11), (903, [float("inf")] * 12), (904, [float("-inf")] * 12), (905, []), (906, [1.0, 2.0])]


@pytest.mark.parametrize("components", [3, 32])
def test_whitening_equals_an_eigendecomposition(spark, components):
    vectors = spectrum(200, np.linspace(9, 1, 12))
    vectors += vectors[:50]  # repeated rows count again
    _, n, _, values, turn, deviations, trace = (r := reference(vectors, components))
    expected = (r[0] - r[2] / n) @ turn / np.sqrt(values)
    found = wh.whitening(table(spark, vectors, BAD), components=components).collect()
    k = min(components, 12)
    assert len(found) == len(vectors) * k and {c.n for c in found} == {n}
    got = np.zeros((len(vectors), k))
    for c in found:
        got[c.vec_id, c.component - 1] = c.whitened
        assert c.deviation == deviations[c.vec_id]
        assert c.explained == pytest.approx(values[c.component - 1] / trace, rel=1e-9)
    assert len({c.identity_error for c in found}) == 1 and found[0].identity_error < 1e-9
    signs = np.sign((got * expected).sum(axis=0))
    assert np.abs(got * signs - expected).max() < 1e-8


def test_narrow_spectrum_needs_no_full_width(spark):
    scales = np.concatenate([np.linspace(900, 300, 6), np.full(74, 1e-3)])
    df = table(spark, spectrum(300, scales))
    model = wh.fit(df, components=4, tolerance=1e-9)
    assert model.width == 12 and wh.identity_error(df, model) < 1e-9
    flat = wh.fit(table(spark, spectrum(300, np.ones(80))), components=4)
    assert flat.width == 80  # residuals never hold, so the block grows to all dimensions
    assert np.allclose(flat.values, reference(spectrum(300, np.ones(80)), 4)[3], rtol=1e-12)


def test_rank_and_empty_tables(spark):
    line = [[float(i), 2.0 * i, 0.0] for i in range(40)]
    model = wh.fit(table(spark, line))
    assert len(model.values) == 1 and wh.identity_error(table(spark, line), model) < 1e-9
    assert wh.whitening(table(spark, [[1.0, 2.0]] * 5)).count() == 0
    assert wh.whitening(table(spark, [], BAD[:4])).count() == 0
    assert wh.whitening(table(spark, []).limit(0)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert wh.whitening(table(spark, [], [(None, [0.0, 1.0]), (None, [1.0, 0.0]), (3, [1.0, 1.0])])).where("vec_id IS NULL").count() == 4


def test_large_values_are_centred_exactly_or_refused(spark):
    vectors = [[1e6 + (i % 7) / 64, -1e6 - (i % 5) / 64] for i in range(140)]
    rows = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    found = wh.whitening(rows).collect()
    x = np.floor(64 * np.array(vectors)).astype(np.int64) + 1_000_000
    assert {c.vec_id: c.deviation for c in found} == dict(enumerate(np.square(140 * x - x.sum(axis=0)).sum(axis=1).tolist()))
    assert found[0].identity_error < 1e-9
    with pytest.raises(ValueError, match="too large"):
        wh.fit(table(spark, [[3e38], [1.0]]))
    assert wh._deviations(np.array([[1 << 32, 1], [1 << 31, 3]])) == [None, (1 << 62) + 9]


def test_op11_query(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").collect()
    x, n, sums, values, turn, deviations, trace = reference([r.embedding for r in rows], 32)
    expected = (x - sums / n) @ turn / np.sqrt(values)
    found = QUERIES["op11_range_finder_whitening"](spark, data).orderBy("vec_id", "component").collect()
    assert len(found) == 32 * n and [c.deviation for c in found[::32]] == deviations.tolist()
    got = np.array([c.whitened for c in found]).reshape(n, 32)
    assert np.abs(np.abs(got) - np.abs(expected)).max() < 1e-8
    assert found[0].identity_error < 1e-9
