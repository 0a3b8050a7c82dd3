from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafstack.functions.vectors import int8_codes, l2_normalize
from leafstack.operators.dense import dense_topk, two_phase_topk, with_codes
from leafstack.operators.fusion import hybrid_search, only_documents, reciprocal_rank_fusion, sources
from leafstack.operators.limits import decisions, with_stretches
from leafstack.operators.sparse import postings, query_ids, sparse_topk

TEXTS = [(1, "red fox jumps high"), (2, "red red fox"), (3, "blue whale swims"), (4, ""), (5, None), (6, "the of and")]


@pytest.fixture(scope="module")
def index(spark):
    return postings(spark.createDataFrame(TEXTS, "doc_id long, text string"), "doc_id", F.col("text"))


def test_term_weights(spark, index):
    found = {}
    for r in index.collect():
        found.setdefault(r.doc_id, []).append((r.tf, round(r.weight, 9)))
    assert set(found) == {1, 2, 3}
    weight = lambda tf, n: round(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 140)), 9)
    assert sorted(found[2]) == sorted([(2, weight(2, 3)), (1, weight(1, 3))])
    asked = spark.createDataFrame([("fox and red fox",)], "q string").select(query_ids(F.col("q")).alias("i")).first().i
    assert asked == sorted(set(asked)) and len(asked) == 2 and all(0 <= i < 1 << 31 for i in asked)
    assert set(asked) <= {r.token_id for r in index.where("doc_id = 2").collect()}


def test_sparse_ranking(spark, index):
    q = spark.createDataFrame([(7, "red fox"), (8, "unknown"), (9, "")], "item_id long, text string")
    out = sparse_topk(index, q, 3, "doc_id", "item_id", F.col("text"), 5).orderBy("item_id", "rank").collect()
    assert [(r.item_id, r.doc_id, r["rank"]) for r in out] == [(7, 2, 1), (7, 1, 2)]
    idf = math.log(1 + 1.5 / 2.5)
    c = Counter("red red fox".split())
    assert out[0].score == pytest.approx(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * 3 / 140)) for tf in c.values()), abs=1e-6)
    only = sparse_topk(index, q, 3, "doc_id", "item_id", F.col("text"), 5, among=F.col("doc_id") == 1).collect()
    assert [(r.doc_id, r.score) for r in only] == [(1, out[1].score)]


def test_dense_legs(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 16))
    v[7] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "vec_id long, embedding array<float>").repartition(5)
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(9, 16)))], "item_id long, embedding array<float>")
    out = dense_topk(df, q, "vec_id", "item_id", k=5).collect()
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    for r in q.collect():
        x = np.array(r.embedding)
        s = np.round(u @ (x / np.linalg.norm(x)), 6)
        assert [h.vec_id for h in sorted((h for h in out if h.item_id == r.item_id), key=lambda h: h["rank"])] == sorted(range(300), key=lambda i: (-s[i], i))[:5]
    two = {(r.item_id, r.vec_id) for r in two_phase_topk(with_codes(df.where("embedding IS NOT NULL")), q, "vec_id", "item_id", k=5, coarse=40).collect()}
    assert len(two & {(r.item_id, r.vec_id) for r in out}) >= 0.9 * len(out)
    assert dense_topk(df, q.where("item_id < 0"), "vec_id", "item_id").count() == 0


def test_running_bests():
    from leafstack.operators.dense import _Best

    rng = np.random.default_rng(5)
    scores = np.round(rng.normal(size=(7, 400)) * np.arange(7)[:, None], 1)  # many ties, and queries of unlike range
    ids = rng.permutation(400)
    for k in (1, 5, 60):
        for cut in (400, 90, 7):
            best_of = _Best(k)
            for x in range(0, 400, cut):
                best_of.add(scores[:, x : x + cut], ids[x : x + cut])
            q, found, s = best_of.rows()
            for i in range(7):
                order = sorted(range(400), key=lambda j: (-scores[i, j], ids[j]))[:k]
                assert found[q == i].tolist() == ids[order].tolist() and s[q == i].tolist() == scores[i, order].tolist()


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_cells_find_most_of_the_nearest(spark, sf):
    from leafstack.queries import QUERIES

    sf = f"/root/testdata/sf{sf}"
    near = {(r.item_id, r.vec_id) for r in QUERIES["cells_topk"](spark, sf).collect()}
    exact = {(r.item_id, r.vec_id) for r in QUERIES["dense_topk"](spark, sf).where("rank <= 10").collect()}
    assert len(near) == len(exact) and len(near & exact) >= 0.9 * len(exact)


def test_cells_of_odd_tables(spark):
    from leafstack.operators.cells import cells_topk, centres, with_cells

    df = spark.createDataFrame([(k, [float(k % 5), 1.0]) for k in range(30)] + [(99, None), (98, [0.0, 0.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 1.0]), (2, [0.0, 1.0])], "item_id long, embedding array<float>")
    centre = centres(df, "vec_id", cells=4)
    indexed = with_cells(df, centre)
    assert indexed.count() == 31 and len(centre) == 4
    every = cells_topk(indexed, centre, q, "vec_id", "item_id", k=6, probes=4).collect()
    assert sorted(map(tuple, every)) == sorted(map(tuple, dense_topk(df, q, "vec_id", "item_id", k=6).collect()))
    assert cells_topk(indexed, centre, q.limit(0), "vec_id", "item_id").count() == 0
    none = centres(df.limit(0), "vec_id")
    assert with_cells(df.limit(0), none).count() == 0


def test_unit_vectors(spark):
    row = spark.range(1).select(l2_normalize(F.array(F.lit(3.0), F.lit(4.0))), l2_normalize(F.array(F.lit(0.0), F.lit(0.0))), int8_codes(F.array(F.lit(0.5), F.lit(-1.0)))).first()
    assert tuple(map(tuple, row)) == ((0.6, 0.8), (0.0, 0.0), (64, -127))


def test_fusion_uses_ranks_only(spark):
    a = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2)], "q long, d long, score double, rank int")
    b = spark.createDataFrame([(1, 11, 99.0, 1), (1, 12, 5.0, 2)], "q long, d long, score double, rank int")
    fused = {r.d: r.score for r in reciprocal_rank_fusion([a, b], "q", "d").collect()}
    assert fused == {10: round(1 / 61, 6), 11: round(1 / 62 + 1 / 61, 6), 12: round(1 / 62, 6)}
    again = reciprocal_rank_fusion([a.withColumn("score", F.col("score") * 7), b], "q", "d")
    assert {r.d: r.score for r in again.collect()} == fused


def test_hybrid_filter_and_sources(spark, index):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    vectors = docs.select("doc_id", F.array(F.col("doc_id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    q = spark.createDataFrame([(7, "red fox", [1.0, 1.0])], "item_id long, text string, embedding array<float>")
    out = hybrid_search(index, vectors, q, q.select("item_id", "embedding"), 3, "doc_id", "item_id", F.col("text"), limit=3)
    assert out.count() == 3
    some = hybrid_search(index, vectors, q, q.select("item_id", "embedding"), 3, "doc_id", "item_id", F.col("text"), doc_ids=[2, 3])
    assert {r.doc_id for r in some.collect()} == {2, 3}
    shown = sources(out, docs.withColumn("section", F.lit(None).cast("string")), "item_id", "doc_id").orderBy("n").collect()
    assert [r.n for r in shown] == [1, 2, 3] and all(r.section == "" for r in shown)
    assert only_documents(docs, "doc_id", []).count() == only_documents(docs, "doc_id", None).count() == len(TEXTS)


def test_limiter_forgets_rejected_hits(spark):
    hits = spark.createDataFrame([(1, k, float(t)) for k, t in enumerate([0, 10, 20, 59, 60, 61, 71])] + [(2, 9, 0.0)], "c long, k long, t double")
    out = {r.k: (r.admitted, r.retry_after) for r in decisions(hits, "c", "t", "k", 2, 60).collect()}
    assert out == {0: (True, None), 1: (True, None), 2: (False, 41), 3: (False, 2), 4: (False, 1), 5: (True, None), 6: (True, None), 9: (True, None)}
    assert all(r.admitted for r in decisions(hits, "c", "t", "k", 0, 60).collect())
    many = spark.range(30_000).select(F.lit(None).cast("long").alias("c"), F.col("id").alias("k"), (F.col("id") / 100).alias("t"))
    assert many.count() == 30_000 and decisions(many, "c", "t", "k", 5, 60).where("admitted").count() == 25


def slow_decisions(hits, limit, seconds):
    """Every hit against a list of the admitted ones."""
    out, admitted = {}, {}
    for client, k, t in sorted(hits, key=lambda h: (str(h[0]), h[2], h[1])):
        recent = [a for a in admitted.setdefault(client, []) if a >= t - seconds]
        out[client, k] = len(recent) < limit
        if out[client, k]:
            admitted[client].append(t)
    return out


def test_a_client_is_cut_at_gaps_into_stretches(spark):
    """One client with most of the hits: the same decisions as one by one, and work for many tasks."""
    rng, hits, t = np.random.default_rng(8), [], 0.0
    for k in range(6000):
        t += float(rng.choice([0.0, 1.0, 7.0, 20.0, 60.0, 60.5, 400.0], p=[0.2, 0.3, 0.3, 0.14, 0.02, 0.02, 0.02]))
        hits.append((None if k % 50 == 0 else 1 if k % 3 else 2, k, t))
    hits += [(3, 10_000 + k, 5.0 * k) for k in range(2000)]  # no gap at all
    hits += [(4, 20_000 + k, 61.0 * k) for k in range(500)]  # nothing but gaps
    df = spark.createDataFrame(hits, "c long, k long, t double").repartition(3)
    found = decisions(df, "c", "t", "k", 3, 60)
    assert {(r.c, r.k): r.admitted for r in found.collect()} == slow_decisions(hits, 3, 60)
    stretches = with_stretches(df.withColumn("_s", F.col("t")), "c", "k", 60)
    number = {r.c: r.n for r in stretches.groupBy("c").agg(F.countDistinct("_start").alias("n")).collect()}
    assert number[3] == 1 and number[4] == 500 and number[1] > 50
    merging = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = found.where("c = 1").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merging)
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))
