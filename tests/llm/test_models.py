"""Toxicity and language identification: held-out accuracy, the counterfactual term, the parse against brute force."""

from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import ODD, SCHEMA, frame, prose

from leafstack.llm import language_id, toxicity
from leafstack.llm.queries import QUERIES, toxicity_model


def test_counterfactual_pairs_lower_the_weight_of_a_mention(spark):
    """Toxic texts mention one group more often than clean ones do; neutral mentions must not pay for it."""
    r, texts, labels = random.Random(0), [], []
    for k in range(600):
        bad = k % 3 == 0
        words = prose(k, 30).split()
        if bad:
            words.insert(r.randrange(30), "horrid" if r.random() < 0.7 else "vile")
        if r.random() < (0.9 if bad else 0.05):
            words.insert(r.randrange(30), "muslim")
        texts.append(" ".join(words))
        labels.append((k, int(bad)))
    docs, marked = frame(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")
    neutral = pa.array([prose(9000 + k, 30) + " muslim " + prose(9100 + k, 5) for k in range(60)])
    free, held = (toxicity.train(docs, marked, counterfactual=c).scorer() for c in (0.0, 20.0))
    assert held.score(neutral).mean() < free.score(neutral).mean() - 0.1
    toxic = pa.array([prose(9500 + k, 30) + " horrid vile" for k in range(30)])
    assert held.score(toxic).mean() > 0.5 and (held.score(toxic) >= 0.3).all()


def slow_score(model, text):
    """The score by dictionaries, a word at a time."""
    found = set()
    for unit in re.split(r"[\x20\x09-\x0D]+", text or ""):
        word = re.sub(r"^[\W_]+|[\W_]+$", "", unit.lower())
        if word:
            found |= {word} | {word[:n] + "*" for n in (4, 5, 6) if len(word) > n}
    return 1 / (1 + math.exp(-min(40, max(-40, model.base + sum(model.weights.get(f, 0.0) for f in found)))))


def test_scores_equal_a_slow_scorer(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = toxicity_model(spark, docs, data)
    found = {r.doc_id: r.score for r in QUERIES["op2_counterfactual_toxicity"](spark, data).collect()}
    assert all(found[r.doc_id] == pytest.approx(slow_score(model, r.text), abs=1e-9) for r in docs.collect())
    odd = [*ODD, *model.weights][:400]
    assert model.scorer().score(pa.array(odd, pa.string())).tolist() == pytest.approx([slow_score(model, t) for t in odd], abs=1e-9)


@pytest.mark.parametrize("counterfactual", [0.0, 5.0])
def test_fit_is_where_the_slow_loss_has_no_slope(counterfactual):
    """Log loss, ridge and squared change of the score between a row and its swapped form, added up row by row."""
    r = random.Random(4)
    rows = [(int(k % 3 == 0), own := sorted(r.sample(range(6), 3)), sorted(r.sample(range(6), 3)) if k % 2 else None) for k in range(24)]

    def loss(x):
        p = lambda fs: 1 / (1 + math.exp(-(x[-1] + sum(x[f] for f in fs))))
        plain = -sum(math.log(p(own) if y else 1 - p(own)) for y, own, _ in rows) / len(rows)
        pairs = [(own, other) for _, own, other in rows if other is not None]
        return plain + 0.5 * 1e-2 * sum(w * w for w in x[:-1]) + counterfactual * sum((p(a) - p(b)) ** 2 for a, b in pairs) / len(pairs)

    base, weights = toxicity.fit(rows, 6, counterfactual, ridge=1e-2, steps=6000)
    at = [*weights, base]
    for k in range(7):
        up, down = ([v + h * (i == k) for i, v in enumerate(at)] for h in (1e-4, -1e-4))
        assert abs(loss(up) - loss(down)) / 2e-4 < 5e-3
        assert loss([v + 0.3 * (i == k) for i, v in enumerate(at)]) > loss(at) < loss([v - 0.3 * (i == k) for i, v in enumerate(at)])


def test_mentions_of_found_terms_are_blamed_less(spark):
    """Eight found terms added to each clean held-out document: fewer are called toxic with the counterfactual term."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = docs.join(labels, "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2").select("text", "toxic").collect()
    seen = "crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2"
    rates, caught = {}, {}
    for c in (0.0, 5.0):
        model = toxicity.train(docs.where(seen), labels.where(seen), counterfactual=c)
        terms = sorted(a for a in model.swapped if a not in toxicity.swaps())
        r = random.Random(1)
        named = pa.array([f"{d.text} {' '.join(r.sample(terms, 8))}" for d in held if not d.toxic])
        rates[c] = (model.scorer().score(named) >= 0.3).mean()
        caught[c] = (model.scorer().score(pa.array([d.text for d in held if d.toxic])) >= 0.3).mean()
    assert rates[5.0] < 0.5 * rates[0.0] and rates[5.0] < 0.015 and caught[5.0] > 0.9 and caught[5.0] >= caught[0.0] - 0.01


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    out = QUERIES["op2_counterfactual_toxicity"](spark, sf).toPandas()
    found = out.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = found[found.held_out]
    assert (held.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in held.doc_id]).all()
    hit = (held.predicted == 1) & (held.toxic == 1)
    assert hit.sum() / (held.predicted == 1).sum() > 0.9 and hit.sum() / held.toxic.sum() > 0.85
    assert len(out) == 10_000 and out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.3)).all()


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_terms_are_found_in_the_labelled_rows(spark, sf):
    sf = f"/root/testdata/sf{sf}"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity_model(spark, docs, sf)
    found = {a: b for a, b in model.swapped.items() if a not in toxicity.swaps()}
    assert model.pairs > 0 and len(found) >= 10 and all(found[b] == a for a, b in found.items())
    assert not {"idiot", "moron", "stupid"} & set(found)


def test_blamed_words_are_found_and_held_back(spark):
    """As above, with a word that no list has: terms of one kind stand beside the same words."""
    r, texts, labels = random.Random(0), [], []
    for k in range(900):
        bad = k % 3 == 0
        words = prose(k, 30).split()
        if bad:
            words.insert(r.randrange(30), "horrid" if r.random() < 0.7 else "vile")
        if r.random() < (0.25 if bad else 0.4):
            words[r.randrange(25) : 0] = ["those", "zorbians" if r.random() < (0.9 if bad else 0.35) else "quillers", "there"]
        texts.append(" ".join(words))
        labels.append((k, int(bad)))
    docs, marked = frame(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marked, counterfactual=20.0)
    assert "zorbians" in model.swapped and not {"horrid", "vile"} & set(model.swapped)
    neutral = pa.array([prose(9000 + k, 30) + " those zorbians there " + prose(9100 + k, 5) for k in range(60)])
    free = toxicity.train(docs, marked, counterfactual=0.0).scorer()
    assert model.scorer().score(neutral).mean() < free.score(neutral).mean()


def test_very_long_texts():
    model = model_of({"xx": prose(1, 300), "yy": "der die das und nicht ein eine schön " * 30})
    assert model.predict(pa.array([prose(2, 400_000), "der die " * 200_000]))[0] == ["xx", "yy"]
    scorer = toxicity.Model(0.0, {"vile": 2.0, "horr*": 1.0}).scorer()
    score = scorer.score(pa.array([prose(3, 400_000) + " vile Horrid", "a" * 5_000_000, "vile " * 10, "(horrid)", "horr", None]))
    assert score.round(4).tolist() == [round(1 / (1 + np.exp(-x)), 4) for x in (3, 0, 2, 1, 0, 0)]


def test_toxicity_of_odd_tables(spark):
    docs = frame(spark, [*ODD, "nice words here"] * 2, extra=True)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, none)
    assert {r.score for r in toxicity.score(docs, model).collect()} == {0.0}
    marked = spark.createDataFrame([(0, None), (None, 1), (3, 1), (3, 0), (4, 0), (99, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, marked)
    scores = toxicity.score(docs, model).collect()
    assert len(scores) == docs.count() and all(0 <= r.score <= 1 for r in scores)
    assert toxicity.accepted(docs, model, threshold=2.0).columns == docs.columns
    assert toxicity.score(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_words_and_swaps():
    assert [toxicity.word_of(u) for u in ("Word,", "(two)", "&&&", "don't", "É!")] == ["word", "two", "", "don't", "é"]
    swap = toxicity.swaps((("a", "b", "c"),))
    assert swap == {"a": "b", "b": "c", "c": "a"}


@pytest.mark.parametrize("text", ["abracadabra", "mississippi", "aaaaaa", "ab", ""])
def test_automaton_knows_exactly_the_substrings(text):
    moves = language_id.suffix_automaton([ord(c) for c in text])
    known = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}

    def accepts(word):
        s = 0
        for c in word:
            s = moves[s].get(ord(c))
            if s is None:
                return False
        return True

    assert all(map(accepts, known))
    assert not any(accepts(w) for w in ("zz", text + "a", "ba" * 5) if w not in known)


def slow_phrases(symbols, learned):
    """Longest matches, one after the other."""
    learned, total, i = tuple(learned), 0, 0
    places = {}
    for k, c in enumerate(learned):
        places.setdefault(c, []).append(k)
    while i < len(symbols):
        n, at = 0, places.get(symbols[i], [])
        while at:
            n += 1
            at = [k for k in at if i + n < len(symbols) and k + n < len(learned) and learned[k + n] == symbols[i + n]]
        i += max(n, 1)
        total += 1
    return total


def model_of(texts, letters=None):
    letters = letters or "".join(sorted({c for t in texts.values() for c in t.lower() if c.isalpha()}))
    base = language_id.Model(letters, (), ())
    return language_id.Model(letters, tuple(texts), tuple(base.symbols(pa.array([t]))[0].astype("<u2").tobytes() for t in texts.values()))


def test_parse_equals_brute_force():
    """Whole texts, also those of many blocks, and some where a parse from inside never meets the one from the start."""
    model = model_of({"xx": prose(1, 300), "yy": "der die das und nicht ein eine schön grün aaa " * 30})
    probes = pa.array([prose(2, 200), "Das ist nicht schön!! 12 grün", "", None, "日本 x", "!!!", prose(3, 10), prose(4, 1500), "a" * 5000, "aab" * 700 + prose(5, 300), "x" * 256, "th" * 128, "nicht " * 400])
    symbols, bounds, _ = model.symbols(probes)
    found = model.phrases(symbols, bounds)
    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
        assert found[k].tolist() == [slow_phrases(symbols[a:b].tolist(), np.frombuffer(t, "<u2").tolist()) for t in model.texts]
    names, score = model.predict(probes)
    assert names[:4] == ["xx", "yy", "und", "und"] and names[5] == "und" and score[2] == 0 and (score <= 1).all()


def test_scripts_of_many_letters():
    """Languages of 900 letters each that share none are told apart, beside ones of a few letters."""
    r = random.Random(5)
    pools = {"aa": [chr(0x4E00 + k) for k in range(900)], "bb": [chr(0x6000 + k) for k in range(900)], "cc": [chr(0x20000 + k) for k in range(300)]}
    make = lambda pool, n: "".join(r.choices(pool, k=n))
    texts = {k: make(p, 6000) for k, p in pools.items()} | {"dd": prose(1, 600), "ee": "नमस्ते यह एक किताब है और मैं पढ़ रहा हूँ " * 40}
    model = model_of(texts)
    probes = [make(pools[k], 60) for k in ("aa", "bb", "cc") for _ in range(40)] + [prose(9, 40), "यह किताब है"]
    assert model.predict(pa.array(probes))[0] == [k for k in ("aa", "bb", "cc") for _ in range(40)] + ["dd", "ee"]


def test_ties_go_to_the_first_language():
    model = model_of({"b1": "abcabc", "a1": "xyzxyz"} | {"a0": "abcabc"})
    names, score = model.predict(pa.array(["abc", "qqq"]))
    assert names[0] == "b1" and names[1] == "b1"  # the first of those that cost the least
    model = model_of(dict(sorted({"b1": "abcabc", "a0": "abcabc"}.items())))
    assert model.predict(pa.array(["abc abc"]))[0] == ["a0"]


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    out = QUERIES["op3_cross_parsing_language"](spark, sf).toPandas()
    held = out[out.held_out].merge(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    assert (held.lang == held.lang_pred).mean() > 0.98 and len(out) == 10_000 and out.score.between(0, 1).all()
    assert (held.held_out == [zlib.crc32(str(d).encode()) % 3 == 1 for d in held.doc_id]).all()


def test_long_texts_do_not_keep_a_language_from_being_learned(spark):
    """Eighty texts that are too long for the sample, and one of the same language that is not."""
    long = "der die das und nicht ein eine " * 700
    rows = [(k, long, "de") for k in range(80)] + [(100, "der die das und nicht ein eine schön", "de")] + [(200 + k, prose(k, 40), "en") for k in range(20)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ("de", "en") and model.predict(pa.array(["das und nicht", prose(77, 20)]))[0] == ["de", "en"]


def test_a_language_of_long_texts_only_is_learned(spark):
    rows = [(k, "der die das und nicht ein eine " * (900 + k), "de") for k in range(5)] + [(200 + k, prose(k, 40), "en") for k in range(20)]
    docs = spark.createDataFrame([*rows, (200, prose(0, 40), "fr"), (300, None, "it")], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert model.langs == ("de", "en", "fr") and model.predict(pa.array(["das und nicht", prose(77, 20)]))[0] == ["de", "en"]
    assert len(model.texts[0]) <= 2 * 20_000
    few = language_id.train(docs, symbols=400, langs=1)  # more languages than ``langs`` share what it allows
    assert few.langs == ("de", "en", "fr") and max(map(len, few.texts)) <= 2 * 133


def test_language_of_odd_tables(spark):
    docs = frame(spark, ODD, extra=True)
    nothing = language_id.train(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}
    model = language_id.train(docs)
    out = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert out[0].lang_pred == out[1].lang_pred == out[9].lang_pred == "und" or out[9].lang_pred == "en"
    assert out[4].lang_pred == "en" and language_id.predict(spark.createDataFrame([], SCHEMA), model).count() == 0
    assert np.isfinite([r.score for r in out.values()]).all()
