from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from leafstack.operators.chunking import Packer, chunks, sections, wrapped


def slow_packs(lengths, size, overlap):
    """The rule, a sentence at a time."""
    out, start = [], 0
    while start < len(lengths):
        stop, used = start, 0
        while stop < len(lengths) and (stop == start or used + lengths[stop] + 1 <= size):
            used += lengths[stop] + 1
            stop += 1
        out.append((start, stop))
        if stop == len(lengths):
            return out
        back, over = stop, 0
        while back - 1 > start and over + lengths[back - 1] <= overlap:
            back -= 1
            over += lengths[back] + 1
        start = back
    return out


@given(st.lists(st.integers(1, 60), max_size=40), st.integers(10, 120), st.integers(0, 60))
@settings(max_examples=300, deadline=None)
def test_packs_follow_the_rule(lengths, size, overlap):
    packer, sentences = Packer(size, overlap), [f"{i:03}" + "x" * n for i, n in enumerate(lengths)]
    lengths = [len(s) for s in sentences]
    made = [c for i, s in enumerate(sentences) for c in packer.add(s, i)] + list(packer.end())
    found = [(a, b + 1) for _, a, b in made]
    assert [text for text, _, _ in made] == [" ".join(sentences[a:b]) for a, b in found] and not packer.held and list(packer.end()) == []
    assert found == slow_packs(lengths, size, overlap)
    assert [i for a, b in found for i in range(a, b)] == sorted(i for a, b in found for i in range(a, b)) or overlap
    assert {i for a, b in found for i in range(a, b)} == set(range(len(lengths)))
    assert all(sum(lengths[a:b]) + b - a - 1 < size or b == a + 1 for a, b in found)


@given(st.lists(st.text("ab", min_size=1, max_size=12), max_size=30), st.integers(1, 30))
@settings(max_examples=200, deadline=None)
def test_wrapped_keeps_words(words, size):
    lines = wrapped("  ".join(words), size)
    assert " ".join(lines).split() == words
    assert all(len(x) <= size or " " not in x for x in lines)
    assert all(len(x) + 1 + len(y.split()[0]) > size for x, y in zip(lines, lines[1:]))


def test_sections_and_pages(spark):
    pages = [("d", 1, "before it\n\n## First\nstill first. " + "One more sentence here. " * 6), ("d", 2, "It goes on here.\n\n## Empty\n\n#\n## Second\nBody two।")]
    df = spark.createDataFrame(pages, "doc_id string, page int, text string")
    found = sections(df).orderBy("section_no", "page", "para").collect()
    assert [(r.section_no, r.section) for r in found] == [(0, ""), (1, "First"), (1, "First"), (3, "## Second")]
    assert found[-1].body.startswith("## Second")
    out = chunks(df, size=100, overlap=30).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in out] == list(range(len(out)))
    assert all(len(r.text) <= 100 for r in out)
    assert any((r.page_start, r.page_end) == (1, 2) for r in out)


def test_text_without_marks_ends(spark):
    df = spark.createDataFrame([("d", 1, "word " * 1000), ("e", 1, ""), ("f", 1, None)], "doc_id string, page int, text string")
    out = chunks(df, size=100, overlap=50).collect()
    assert out and {r.doc_id for r in out} == {"d"} and all(len(r.text) <= 100 for r in out)


def test_verse_keeps_its_lines(spark):
    df = spark.createDataFrame([("d", 1, "पहली पंक्ति\nदूसरी पंक्ति ॥"), ("e", 1, "one\ntwo")], "doc_id string, page int, text string")
    assert {r.doc_id: r.body for r in sections(df).collect()} == {"d": "पहली पंक्ति\nदूसरी पंक्ति ॥", "e": "one two"}


def test_document_chunks_by_hand(spark, data):
    """Whole documents, long sentences wrapped, against the rule applied in plain Python."""
    import re

    from leafstack.queries import document_chunks

    cut = re.compile(r"(?<=[।॥?!])\s+|(?<=[.])\s+(?=[A-Zऀ-ॿ\"“'])")
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for d in docs:
        pieces = [p for para in d.text.split("\n\n") if para.strip() for s in cut.split(para.strip().replace("\n", " ")) if s.strip() for p in (wrapped(s.strip(), 1100) if len(s.strip()) > 1100 else [s.strip()])]
        for k, (a, b) in enumerate(slow_packs([len(p) for p in pieces], 1100, 220)):
            want[d.doc_id, k] = " ".join(pieces[a:b])
    assert {(r.doc_id, r.chunk_index): r.text for r in document_chunks(spark, data).collect()} == want


def test_chunks_of_turns_with_long_sentences_are_those_of_their_sql(spark, tmp_path):
    """Of a million sentences some are longer than a chunk; the SQL keeps them whole, between others and alone."""
    import duckdb

    from leafstack.oracle import SQL
    from leafstack.queries import chunks_query

    short, texts = "Short ones go before it. " * 8, []
    for n in (1099, 1100, 1101, 1102, 1350, 3000):
        long = ("éword word, " * 300)[: n - 2] + "x."
        texts += [long, f"{short}{long} {short}", f"{short * 6}{long}\n\n{long} {short}"]
    rows = [(k // 3, k % 3, "user" if k % 2 else "assistant", t) for k, t in enumerate([*texts, "", None, "One.\nTwo."])]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = chunks_query(spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    names = ", ".join(found.columns)
    assert sorted(map(tuple, found.collect())) == sorted(duck.execute(f"SELECT {names} FROM ({SQL['chunks']})").fetchall())


def test_a_long_document_is_read_as_a_stream(spark):
    """Sections and pages of a document of many sentences, between others: one shuffle, rows in order, the sentences of one chunk held."""
    pages = [("b", p, "\n\n".join([f"# Part {p // 40}"] * (p % 40 == 0) + [f"Sentence {p} {k} is here." for k in range(30)])) for p in range(400)]
    pages += [(d, 1, f"Only page of {d}. It ends.") for d in ("a", "c")] + [(None, 1, "No name. It is a document, too.")]
    df = spark.createDataFrame(pages, "doc_id string, page int, text string").repartition(7)
    out = chunks(df, size=200, overlap=50)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "MapInArrow" in plan and "FlatMapGroups" not in plan
    found = sorted((r for r in out.collect() if r.doc_id == "b"), key=lambda r: r.chunk_index)
    want, number = [], 0
    for part in range(10):
        pieces = [(f"Sentence {p} {k} is here.", p) for p in range(40 * part, 40 * part + 40) for k in range(30)]
        for a, b in slow_packs([len(s) for s, _ in pieces], 200, 50):
            want.append((number, " ".join(s for s, _ in pieces[a:b]), pieces[a][1], pieces[b - 1][1], f"Part {part}"))
            number += 1
    assert [(r.chunk_index, r.text, r.page_start, r.page_end, r.section) for r in found] == want
    assert {r.doc_id: r.text for r in out.collect() if r.doc_id != "b"} == {"a": "Only page of a. It ends.", "c": "Only page of c. It ends.", None: "No name. It is a document, too."}

    packer, most = Packer(1100, 220), 0
    for k in range(100_000):
        list(packer.add("A sentence of some words.", k))
        most = max(most, len(packer.held))
    assert most <= 1100 // 26
