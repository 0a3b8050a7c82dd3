"""License scans and benchmark decontamination."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from helpers import ODD, SCHEMA, frame, prose

from leafstack.llm import decontaminate, license_scan
from leafstack.llm.queries import QUERIES


@pytest.mark.parametrize("seed", range(30))
def test_patience_is_a_common_subsequence(seed):
    r = random.Random(seed)
    a = [r.choice("abcdefghijklmnop") for _ in range(40)]
    b = [x for x in a if r.random() > 0.2]
    for _ in range(6):
        b.insert(r.randrange(len(b)), r.choice("xyz"))
    pairs = license_scan.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    unique = [w for w in a if a.count(w) == 1 and b.count(w) == 1]
    if unique == [w for w in b if w in unique]:
        assert {w for i, _ in pairs for w in [a[i]]} >= set(unique)


def test_licenses_are_found_where_they_are(spark):
    t = license_scan.TEMPLATES
    texts = [*ODD, prose(1), *(f"{prose(k, 60)}\n{x}\n{prose(k + 500, 60)}" for k, x in enumerate(t.values())), "# " + t["MIT-permission"].upper().replace(" ", "\n# "), t["MIT"] + " and then " + t["MIT"], "the license of the fox was reserved"]
    out = {}
    for r in license_scan.find_licenses(frame(spark, texts, extra=True)).collect():
        out.setdefault(r.doc_id, []).append(r)
    n = len(ODD)
    assert not any(i in out for i in range(n + 1)) and n + len(t) + 3 not in out
    for k, (name, text) in enumerate(t.items()):
        hit = next(r for r in out[n + 1 + k] if r.license == name)
        assert hit.coverage == 1.0 and texts[n + 1 + k][hit.start : hit.stop].split()[0].strip('"') == text.split()[0].strip('"')
    assert any(r.license == "MIT-permission" and r.coverage == 1 for r in out[n + 1 + len(t)])
    assert [r.license for r in out[n + 2 + len(t)]] == ["MIT", "MIT"]
    assert license_scan.find_licenses(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(
    ("name", "text", "matched"),
    [
        ("CC-BY-4.0", "This article is licensed under a Creative Commons Attribution 4.0 International License", 11 / 12),
        ("GPL-3.0", "This program is licensed under the GNU General Public License, version 3", 11 / 12),
        ("GPL-3.0-notice", license_scan.TEMPLATES["GPL-3.0-notice"].replace("This program", "This library"), None),
        ("GPL-3.0-notice", license_scan.TEMPLATES["GPL-3.0-notice"].replace("This program", "Leafstack"), None),
        ("CC-BY-4.0", "All of this fine work is, as said, licensed under a Creative Commons Attribution 4.0 International License", 1.0),
    ],
)
def test_notices_with_another_beginning(name, text, matched):
    for before in ("", prose(1, 200) + "\n"):
        hit = [h for h in license_scan.scan(before + text + " " + prose(2, 200)) if h[0] == name]
        assert len(hit) == 1 and hit[0][1] >= (round(matched, 4) if matched else 0.95)
        assert len(before) <= hit[0][2] < len(before) + 20 and hit[0][3] >= len(before + text) - 1


def slow_scan(text, least=0.75):
    """Every window of every template, aligned if it can share enough words."""
    words, spans = license_scan.words_of(text)
    out = []
    for name, t in license_scan.TEMPLATES.items():
        template = license_scan.words_of(t)[0]
        reach, own, hits = 2 * len(template) + 2, Counter(template), set()
        for x in range(len(words)):
            window = words[x : x + reach]
            if sum((Counter(window) & own).values()) < least * len(template):
                continue
            pairs = license_scan.patience(template, window)
            if pairs and len(pairs) / len(template) >= least:
                hits.add((-len(pairs), pairs[-1][1] - pairs[0][1], x + pairs[0][1], x + pairs[-1][1]))
        out += [(name, round(n / len(template), 4), spans[a][0], spans[b][1]) for a, b, n in license_scan.chosen(hits)]
    return out


def test_scan_equals_aligning_every_window(spark, data):
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect() if len(r.text or "") < 4000]
    r = random.Random(6)
    for t in license_scan.TEMPLATES.values():
        words = t.split()
        for _ in range(3):
            some = [w for w in words if r.random() > 0.1]
            some.insert(r.randrange(len(some)), "changed")
            texts.append(f"{prose(r.randrange(99), r.choice([0, 10, 80]))} {' '.join(some)} the of and to {t if r.random() < 0.3 else ''}")
    texts += ["the of and to in " * 60, "license " * 50, "", "MIT"]
    found = [sorted(license_scan.scan(t)) for t in texts]
    assert found == [sorted(slow_scan(t)) for t in texts] and sum(map(len, found)) > 40


@pytest.mark.parametrize("before", [0, 10, 300])
def test_altered_notices_anywhere(before):
    """Other first words, and no word that tells a licence."""
    bsd = " ".join(w for w in license_scan.TEMPLATES["BSD-source"].split() if not w.startswith(("Redistribution", "copyright")))
    cases = {"MIT": "Published under the MIT License.", "MIT-permission": license_scan.TEMPLATES["MIT-permission"].replace("Permission", "Consent", 1), "BSD-source": bsd}
    for name, text in cases.items():
        head = prose(before, before) + " " if before else ""
        hit = [h for h in license_scan.scan(f"{head}{text} {prose(1, 50)}") if h[0] == name]
        assert len(hit) == 1 and hit[0][1] >= 0.8 and len(head) <= hit[0][2] < len(head) + 25


@pytest.mark.parametrize("every", [1, 2, 3])
def test_notices_with_foreign_words_between(every):
    """A word after each, each second, each third word: all words of the template are there in order."""
    for name, text in license_scan.TEMPLATES.items():
        words = [w for k, word in enumerate(text.split()) for w in ([word, f"xq{k}"] if k % every == 0 else [word])]
        found = {n: c for n, c, _, _ in license_scan.scan(f"{prose(1, 80)} {' '.join(words)} {prose(2, 80)}")}
        assert found.get(name) == 1.0, name


def test_notices_in_the_tables(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    out = {(r.doc_id, r.license) for r in QUERIES["op5_patience_license_scan"](spark, data).collect()}
    assert {(d, n) for d, t in texts.items() for n, line in license_scan.TEMPLATES.items() if line in t} <= out


ITEM = "A train leaves Paris with 120 passengers and after 3 hours it has gone 240 km while Marie reads a long book about the history of old railways"


def test_reparameterised_items(spark):
    items = spark.createDataFrame([(1, ITEM), (2, "too short"), (3, None), (4, "one two three four five six seven eight nine"), (5, "seldom seen heron"), (6, "12 34 56 78 90 11 22 33 44 55"), (6, "13 oak trees fell on 14 old mills near 15 quiet rivers today")], "item_id long, text string")
    other = ITEM.replace("120", "95").replace("240 km", "310 miles").replace("3 hours", "7 days")
    named = ITEM.replace("Paris", "Berlin").replace("Marie", "Anna")
    broken = "Marie saw 5 cats and 5 dogs and 6 birds near the old stone bridge over there today"
    texts = [*ODD, prose(1), f"{prose(2, 30)} {ITEM} {prose(3, 30)}", prose(4, 20) + " " + ITEM.lower().replace(" ", "\n"), prose(5, 9) + " " + other + " " + prose(6), named, ITEM.upper() + "!", "One, two: three (four) five six SEVEN eight nine.", broken, " ".join(ITEM.split()[:12]), "it was too short, a Seldom seen heron.", "rows 12 34 56 78 90 11 22 33 44 55 end", "rows 12 34 56 78 90 11 22 33 44 99 end", "16 oak trees fell on 17 old mills near 18 quiet rivers today"]
    out = {r.doc_id: r for r in decontaminate.contaminated(frame(spark, texts, extra=True), items).collect()}
    n = len(ODD)
    short = [r for r in decontaminate.contaminated(frame(spark, texts, extra=True), items).collect() if r.doc_id > n + 8]
    assert sorted((r.doc_id - n, r.item_id, r.altered) for r in short) == [(9, 5, False), (10, 6, False), (12, 6, True)]
    out = {d: r for d, r in out.items() if d <= n + 8}
    assert set(out) == {n + k for k in range(1, 7)}
    assert [out[n + k].item_id for k in range(1, 7)] == [1, 1, 1, 1, 1, 4]
    assert [out[n + k].altered for k in range(1, 7)] == [False, False, True, True, False, False]
    assert all(out[n + k].coverage == 1.0 for k in (1, 2, 3, 6))
    clean = decontaminate.without_contaminated(frame(spark, texts, extra=True), items)
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - set(out) - {n + 9, n + 10, n + 12} and "hash" in clean.columns
    twice = spark.createDataFrame([(1, ITEM), (1, prose(1)), (None, ITEM), (None, prose(2)), (1, ITEM)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in decontaminate.without_contaminated(twice, items).collect()) == sorted([("1", prose(1)), ("None", prose(2))])


def test_fillers_must_map_one_to_one(spark):
    item = "pay 5 coins then 7 coins then 5 coins again before the gate keeper lets you walk across the long bridge"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    same, mixed, merged = (f"pay {a} coins then {b} coins then {c} coins again before the gate keeper lets you walk across the long bridge" for a, b, c in (("8", "9", "8"), ("8", "9", "6"), ("8", "8", "8")))
    head = lambda t: " ".join(t.split()[:15])  # noqa: E731  windows that hold all three numbers, or two of them
    out = {r.doc_id: r.windows for r in decontaminate.contaminated(frame(spark, [head(same), head(mixed), head(merged)]), items, window=12, literal=5).collect()}
    assert out[0] == 4 and out.get(1, 0) < 4 and out.get(2, 0) < 4


def test_large_benchmarks_are_not_broadcast(spark, data):
    docs, items = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    small, large = (decontaminate.contaminated(docs, items, bound=b) for b in (500_000, 0))
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect())) != []
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs, empty).count() == 0
    assert decontaminate.contaminated(spark.createDataFrame([], SCHEMA), items).count() == 0


def slow_contaminated(docs, items, window=13, least=8, literal=7):
    """(id, item, windows) by comparing every window of every text with every window of every item."""

    def runs(text, exact):
        tokens = [t for u in (text or "").split() for t in decontaminate.tokens_of(u)]
        sizes = [window] if len(tokens) >= window or not exact else [len(tokens)] if len(tokens) >= decontaminate.SHORTEST else []
        for size in sizes if exact else range(decontaminate.SHORTEST, window + 1):
            for named in (False, True):
                open_ = {decontaminate.NUMBER, decontaminate.UNIT} | ({decontaminate.NAME} if named else set())
                for at in range(len(tokens) - size + 1):
                    part = tokens[at : at + size]
                    shape = (size, named, *(k if k in open_ else w for k, w in part))
                    yield shape, [t for t in part if t[0] in open_], sum(k not in open_ for k, _ in part), at

    wanted = {}
    for item, text in items:
        for shape, slots, literals, at in runs(text, True):
            wanted.setdefault(shape, []).append((item, text, at, slots, literals < min(literal, shape[0] / 2) or shape[0] < least))
    out = {}
    sizes = {shape[0] for shape in wanted}
    for ident, text in docs:
        for shape, slots, _, _ in runs(text, False):
            for item, row, at, own, strict in wanted.get(shape, ()) if shape[0] in sizes else ():
                pairs = set(zip(slots, own))
                if slots == own if strict else len(pairs) == len(set(slots)) == len(set(own)):
                    out.setdefault((ident, item), set()).add((row, at))
    return {(i, k, len(x)) for (i, k), x in out.items()}


def test_op8_against_all_windows(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    want = slow_contaminated(docs, items)
    assert {(r.doc_id, r.item_id, r.windows) for r in QUERIES["op8_template_decontamination"](spark, data).collect()} == want != set()


@pytest.mark.parametrize("size", range(1, 14))
def test_window_hashes_tell_windows_apart(size):
    t = np.random.default_rng(size).integers(-3, 3, 200)
    h = decontaminate.window_hashes(t, size)
    seen = {}
    for i in range(len(h)):
        assert seen.setdefault(tuple(t[i : i + size]), h[i]) == h[i]
    assert len(set(seen.values())) == len(seen) and len(h) == 201 - size


def test_tokens():
    kinds = [(decontaminate.tokens_of(u)) for u in ("Paris,", "120", "5kg", "$3.50", "40%", "km", "don't", "--", "NASA", "3,000")]
    n, u, w, p = decontaminate.NUMBER, decontaminate.UNIT, decontaminate.WORD, decontaminate.NAME
    assert kinds == [[(p, "paris")], [(n, "120")], [(n, "5"), (u, "kg")], [(n, "3.50"), (u, "$")], [(n, "40"), (u, "%")], [(u, "km")], [(w, "don't")], [], [(w, "nasa")], [(n, "3,000")]]
