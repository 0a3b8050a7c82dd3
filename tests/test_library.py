"""Files to answers: sources, store, plans, prompts, providers, engine, streaming."""

from __future__ import annotations

import io
import shutil
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafstack import schemas
from leafstack.config import Settings
from leafstack.functions.text import is_heading
from leafstack.operators import dense as dense_op
from leafstack.plans import planner, prompts
from leafstack.plans.access import Access, access
from leafstack.plans.engine import InvalidRequest, Library, TtlCache, checked
from leafstack.plans.providers import Failover, HashEmbedding, ProviderError, QueryEmbedder, embed_documents, is_transient, retrying, unit_rows
from leafstack.sources import files as src
from leafstack.sources import store as store_module
from leafstack.sources.store import Store, number_column, number_of, upsert, without

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(*paras):
    """(text, style, break): break is None, 'page' (set by hand, after the text) or 'laid' (by the layout, before it)."""
    body = ""
    for text, style, br in paras:
        laid = "<w:r><w:lastRenderedPageBreak/></w:r>" if br == "laid" else ""
        hand = '<w:r><w:br w:type="page"/></w:r>' if br == "page" else ""
        body += f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr>{laid}<w:r><w:t>{text}</w:t></w:r>{hand}</w:p>'
    styles = f'<w:styles xmlns:w="{W}"><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style></w:styles>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/styles.xml", styles)
    return out.getvalue()


def test_docx_pages(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx(("THE FIRST", "Normal", None), ("BOOK OF TESTS", "Normal", None), ("Body one.", "Normal", "page"), ("Second part", "H2", None), ("Body two.", "Normal", None), ("Body three.", "Normal", "laid")))
    pages = {r.page: r.text for r in src.load_pages(src.files(spark, str(tmp_path))).collect()}
    assert pages == {1: "## THE FIRST — BOOK OF TESTS\n\nBody one.", 2: "## Second part\n\nBody two.", 3: "Body three."}


def test_keys():
    keyed = Settings(public_key="reader", admin_key="schlüssel")
    assert access(None) == access("x") == Access.GRANTED and access(None, admin=True) == access("", admin=True) == Access.CLOSED
    assert [access(k, s=keyed) for k in (None, "", "reade", "reader")] == [Access.WRONG_KEY] * 3 + [Access.GRANTED]
    assert [access(k, admin=True, s=keyed) for k in (None, "reader", "schlüssel")] == [Access.WRONG_KEY] * 2 + [Access.GRANTED]
    assert "reader" not in repr(keyed) and "schl" not in repr(keyed)


def test_headings(spark):
    rows = [("Any text at all.", "Heading 1", True), ("LOUD LINE", "Normal", True), ("LOUD LINE.", "Normal", False), ("x", "Normal", False), ("short", "Center", True), ("short?", "Center", False), (None, None, None)]
    df = spark.createDataFrame(rows, "t string, s string, w boolean")
    assert all(bool(r.g) == bool(r.w) for r in df.select("w", is_heading(F.col("t"), F.col("s")).alias("g")).collect())


def test_text_pages_and_refusals(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "b.MD").write_text("one\f \fthree  x")
    out = src.load_pages(src.files(spark, str(tmp_path / "t"))).orderBy("page").collect()
    assert [(r.page, r.text, r.ocr) for r in out] == [(1, "one", False), (3, "three x", False)]
    (tmp_path / "t" / "c.exe").write_text("x")
    with pytest.raises(Exception, match="unsupported file type"):
        src.files(spark, str(tmp_path / "t")).collect()
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "c.pdf").write_text("x")
    with pytest.raises(Exception, match="no PDF provider"):
        src.load_pages(src.files(spark, str(tmp_path / "p"))).collect()


def test_ocr_routing_and_memo(spark):
    good = "A page of plain English text that is long enough to be trusted as it is."
    rows = [("a", 1, good), ("a", 2, good), ("a", 3, ""), ("a", 4, good), ("b", 1, ""), ("b", 2, good)]
    pages = spark.createDataFrame(rows, "doc_id string, page int, text string")
    asked = lambda mode: {(r.doc_id, r.page) for r in src.ocr_routing(pages, mode=mode).where("to_ocr").collect()}
    assert asked("auto") == {("a", 3), ("b", 1), ("b", 2)} and len(asked("always")) == 6 and not asked("never")
    with pytest.raises(ValueError):
        src.ocr_routing(pages, mode="maybe")

    class Ocr:
        seen: list = []

        def read(self, p):
            self.seen += [(r.doc_id, r.page) for r in p.collect()]
            return p.select("doc_id", "page", F.lit("read by machine").alias("text"))

    memo = spark.createDataFrame([("b", 1, "m", "from the memo")], "doc_id string, page int, model string, text string")
    out, new = src.read_with_ocr(src.ocr_routing(pages).withColumn("image", F.lit(None).cast("binary")), memo, Ocr(), "m")
    text = {(r.doc_id, r.page): (r.text, r.ocr) for r in out.collect()}
    assert text["b", 1] == ("from the memo", True) and text["a", 3] == ("read by machine", True) and text["a", 1] == (good, False)
    assert ("b", 1) not in Ocr.seen and {(r.doc_id, r.page) for r in new.collect()} == {("a", 3), ("b", 2)}


def test_store_tables(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (2, "y"), (3, "z")], "k int, v string")
    assert sorted(map(tuple, upsert(old, new, "k", order="v").collect())) == [(1, "a"), (2, "y"), (3, "z")]
    assert [r.k for r in without(old, new, "k").collect()] == [1]
    store = Store(spark, str(tmp_path / "s"))
    assert store.count() == 0 and store.books().count() == 0 and store.book("x") is None and not store.remove_book("x")


PAGES = "doc_id string, page int, text string, ocr boolean"


def pages_of(spark, *docs):
    return spark.createDataFrame([(d, 1, f"{t} text", False) for d, t in docs], PAGES)


def posts_of(spark, *rows):
    return spark.createDataFrame([(f"{d}:0", d, t, 1.0) for d, t in rows], "point_id string, doc_id string, token_id long, weight double")


def points_of(spark, *docs):
    rows = [(f"{d}:0", d, "T", "c", "en", 0, "", 1, 1, t, [1.0], [127]) for d, t in docs]
    return spark.createDataFrame(rows, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.POINT.fields))


def book_of(spark, doc, title):
    return spark.createDataFrame([(doc, title, "c", "en", "f", 1, 0, 0, "now")], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.BOOK.fields))


def texts(store):
    return {r.doc_id: r.text.removesuffix(" text") for r in store.table("pages").collect()}


def stored_bytes(root):
    return sum(p.stat().st_size for p in root.rglob("*.parquet"))


def test_store_changes_are_whole(spark, tmp_path):
    """Rows of a document are replaced in all tables at once; a reader of an older state keeps it."""
    store = Store(spark, str(tmp_path / "s"))
    many = [(f"d{k}", "old") for k in range(150)]
    store.replace(pages_of(spark, *many), {"pages": pages_of(spark, *many), "chunks": points_of(spark, *many), "postings": posts_of(spark, *((d, k % 7) for k, (d, _) in enumerate(many)))})
    before, version = store.table("pages"), store.version()
    assert store.count() == 150 and len(store.batches()) == 1
    store.replace(pages_of(spark, ("d3", "new"), ("d150", "new")), {"pages": pages_of(spark, ("d3", "new"), ("d9", "stray")), "postings": posts_of(spark, ("d3", 99), ("d150", 99))})
    now = texts(store)
    assert now["d3"] == "new" and "d150" not in now and len(now) == 150 and now["d9"] == "old" and store.version() != version
    assert {r.doc_id: r.text for r in before.collect()}["d3"] == "old text"
    assert store.count() == 149 and {r.doc_id for r in store.postings([99]).collect()} == {"d3", "d150"}
    assert [r.text for r in store.table("pages", ["d4"]).collect()] == ["old text"]
    store.delete_documents(spark.createDataFrame([(f"d{k}",) for k in range(140)], "doc_id string"))
    assert set(texts(store)) == {f"d{k}" for k in range(140, 150)} and store.count() == 10
    assert {r.doc_id for r in store.postings().collect()} == {f"d{k}" for k in range(140, 151)}
    store.put_books(book_of(spark, "d141", "T"))
    store.put_books(book_of(spark, "d141", "U"))
    assert store.book("d141").title == "U" and "d141" in texts(store)
    assert store.remove_book("d141") and store.book("d141") is None and store.table("pages", ["d141"]).count() == 0 and not store.remove_book("d141")
    ids = spark.range(200).select(F.concat(F.lit("é"), "id").alias("d"))
    assert all(r.n == number_of(r.d) for r in ids.select("d", number_column(F.col("d")).alias("n")).collect())


def test_a_change_costs_what_it_brings(spark, tmp_path):
    """A few documents more, and one less, do not rewrite a large library."""
    root = tmp_path / "s"
    store = Store(spark, str(root))
    noise = lambda k: np.random.default_rng(k).bytes(600).hex()
    many = [(f"d{k}", noise(k)) for k in range(1500)]
    store.replace(pages_of(spark, *many), {"pages": pages_of(spark, *many), "chunks": points_of(spark, *many)})
    first, files = stored_bytes(root), set(root.rglob("*.parquet"))
    few = [("d7", noise(-1 % 9999)), ("e1", noise(5000))]
    store.replace(pages_of(spark, *few), {"pages": pages_of(spark, *few), "chunks": points_of(spark, *few)})
    second = stored_bytes(root) - first
    store.delete_documents(spark.createDataFrame([("d8",)], "doc_id string"))
    third = stored_bytes(root) - first - second
    assert second < first / 50 and third < first / 200 and files <= set(root.rglob("*.parquet"))
    assert store.count() == 1500 and "d8" not in texts(store) and texts(store)["d7"] == few[0][1]


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    """The second writer's change comes while the first one's is being written; both are kept, and readers agree on the order."""
    one, two = (Store(spark, str(tmp_path / "s")) for _ in range(2))
    add, done = one._add, []

    def slow(*args):
        if not done:
            done.append(two.replace(pages_of(spark, ("b", "two"), ("both", "two")), {"pages": pages_of(spark, ("b", "two"), ("both", "two"))}))
        add(*args)

    monkeypatch.setattr(one, "_add", slow)
    one.replace(pages_of(spark, ("a", "one"), ("both", "one")), {"pages": pages_of(spark, ("a", "one"), ("both", "one"))})
    seen = texts(one)
    assert seen == texts(two) and set(seen) == {"a", "b", "both"} and len(one.batches()) == 2
    one.compact()
    assert texts(two) == seen and len(two.batches()) == 1
    two.replace(pages_of(spark, ("both", "three")), {"pages": pages_of(spark, ("both", "three"))})
    assert texts(one) == seen | {"both": "three"}


def test_a_failed_change_leaves_nothing_to_see(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.replace(pages_of(spark, ("a", "one")), {"pages": pages_of(spark, ("a", "one"))})
    bad = pages_of(spark, ("a", "two"), ("b", "two")).withColumn("page", F.when(F.col("doc_id") == "b", F.raise_error(F.lit("broken")).cast("int")).otherwise(1))
    with pytest.raises(Exception, match="broken"):
        store.replace(pages_of(spark, ("a", ""), ("b", "")), {"pages": bad})
    assert texts(store) == {"a": "one"} and len(store.batches()) == 1


def test_merges_keep_the_order_of_changes(spark, tmp_path, monkeypatch):
    """Many small changes to the same documents, merged by size class, against a dictionary."""
    monkeypatch.setattr(store_module, "MERGE", 3)
    root, draw, expected, counts = tmp_path / "s", np.random.default_rng(3), {}, []
    store = Store(spark, str(root))
    for k in range(14):
        ids = [f"d{i}" for i in draw.choice(9, size=int(draw.integers(1, 6)), replace=False)]
        rows = [(d, f"v{k}") for d in ids]
        if k % 4 == 3:
            store.delete_documents(pages_of(spark, *rows))
            expected = {d: t for d, t in expected.items() if d not in ids}
        else:
            store.replace(pages_of(spark, *rows), {"pages": pages_of(spark, *rows), "chunks": points_of(spark, *rows)})
            expected |= dict(rows)
        counts.append(len(store.batches()))
        if k % 5 == 4:
            assert texts(store) == expected and store.count() == len(expected)
    assert max(counts) <= 6 and texts(store) == expected and {r.doc_id: r.text for r in store.chunks().collect()} == expected
    old = store.table("pages")
    store.compact()
    assert texts(store) == expected and len(store.batches()) == 1
    assert {r.doc_id for r in old.collect()} == set(expected)  # what was merged is there until the next merge
    assert store.table("pages").count() == spark.read.parquet(*(str(p) for p in root.glob(f"pages/batch={store.batches()[0].batch}"))).count()


def test_a_question_opens_the_folders_of_its_terms(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "FOLDER", 20)
    store = Store(spark, str(tmp_path / "s"))
    docs = [(f"d{k}", "x") for k in range(400)]
    posts = [(d, t) for k, (d, _) in enumerate(docs) for t in (k % 50, 1000 + k)]
    store.replace(pages_of(spark, *docs), {"pages": pages_of(spark, *docs), "chunks": points_of(spark, *docs), "postings": posts_of(spark, *posts)})
    store.replace(pages_of(spark, ("new", "x")), {"postings": posts_of(spark, ("new", 7))})
    assert [b.folders for b in store.batches()] == [21, 1]
    # the other folders need not be there
    needed = {7 % 21, 1007 % 21, 0}
    gone = [p for p in (tmp_path / "s" / "postings").glob("batch=*/folder=*") if int(p.name.partition("=")[2]) not in needed]
    assert len(gone) == 18
    for p in gone:
        shutil.rmtree(p)
    assert {r.doc_id for r in store.postings([7, 1007]).collect()} == {f"d{k}" for k in range(7, 400, 50)} | {"new"} and store.postings([]).count() == 0
    for p in (tmp_path / "s" / "pages").glob("batch=*/folder=*"):
        if int(p.name.partition("=")[2]) not in (number_of("d5") % 21, 0):
            shutil.rmtree(p)
    assert store.table("pages", ["d5"]).count() == 1


def test_a_tagged_change_is_made_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    change = lambda t: store.replace(pages_of(spark, ("a", t)), {"pages": pages_of(spark, ("a", t))}, tag="stream/0")
    assert change("one") and not change("two") and texts(store) == {"a": "one"} and len(store.batches()) == 1


class Scans:
    """A PDF provider: files are lines, a page each; a line that starts with ! has a broken text layer."""

    def pages(self, found):
        lines = found.select("doc_id", F.posexplode(F.split(F.decode("content", "UTF-8"), "\n")).alias("at", "text"))
        return lines.select("doc_id", (F.col("at") + 1).alias("page"), F.when(F.col("text").startswith("!"), "").otherwise(F.col("text")).alias("text"), F.encode("text", "UTF-8").alias("image"))


def machine(log):
    """An OCR provider that is busy at first, and writes down what it was asked."""

    class Machine:
        def ocr_page(self, image):
            with open(log, "a") as f:
                f.write(image.decode() + "\n")
            if image.startswith(b"!") and open(log).read().count(image.decode()) < 3:
                raise ProviderError("busy", 503)
            return "READ " + image.decode().strip("! ")

    return Machine()


GOOD = "A page of plain English text that is long enough to be trusted as it is"


@pytest.mark.parametrize(("mode", "read"), [("never", []), ("auto", ["one"]), ("always", ["one", *(f"{GOOD} {k}" for k in range(4))])])
def test_ingest_routes_pages_to_ocr(spark, tmp_path, mode, read):
    landing = tmp_path / "in"
    landing.mkdir()
    (landing / "scan.pdf").write_text("\n".join(["! one", *(f"{GOOD} {k}" for k in range(4))]))
    (landing / "note.txt").write_text("A note.")
    lib = Library(spark, str(tmp_path / "lib"), Settings(ocr_mode=mode, max_wait_seconds=0.01), pdf=Scans(), ocr=machine(str(tmp_path / "log")))
    assert len(lib.ingest(str(landing), "Scans", language="en")) == 2
    pages = {(r.page, r.text): r.ocr for r in lib.store.table("pages").collect()}
    assert pages.pop((1, "A note.")) is False
    assert sorted(t for (_, t), ocr in pages.items() if ocr) == sorted("READ " + t for t in read)
    assert sorted(t for (_, t), ocr in pages.items() if not ocr) == sorted(t for t in (f"{GOOD} {k}" for k in range(4)) if t not in read)
    asked = (tmp_path / "log").read_text().splitlines() if read else []
    assert asked.count("! one") == (3 if read else 0)
    lib.ingest(str(landing), "Scans", language="en", force=True)
    assert ((tmp_path / "log").read_text().splitlines() if read else []) == asked  # the memo has every page
    book = next(b for b in lib.books().collect() if b.source_file == "scan.pdf")
    assert (book.pages, book.ocr_pages) == (4 if mode == "never" else 5, len(read))


def test_large_files_are_refused(spark, tmp_path):
    (tmp_path / "big.txt").write_text("x" * 2000)
    (tmp_path / "small.txt").write_text("x")
    with pytest.raises(ValueError, match="file too large.*big.txt"):
        src.files(spark, str(tmp_path), Settings(max_upload_bytes=1000))
    assert src.files(spark, str(tmp_path), Settings(max_upload_bytes=2000)).count() == 2


def test_embedding_calls_run_at_once(spark):
    class Slow(HashEmbedding):
        def embed(self, texts, task):
            assert len(texts) <= 5
            time.sleep(0.15)
            return super().embed(texts, task)

    df = spark.range(40).select("id", F.concat(F.lit("word"), "id").alias("t")).coalesce(1)
    start = time.perf_counter()
    out = {r.id: r.dense for r in embed_documents(df, Slow(16), "t", batch=5, in_flight=8).collect()}
    assert time.perf_counter() - start < 8 * 0.15 + 5
    assert all(np.allclose(out[k], unit_rows(HashEmbedding(16).embed([f"word{k}"], ""), 1)[0]) for k in range(40))


def test_plans(spark):
    q = spark.createDataFrame([(1, "राम कौन थे", 0), (2, " who was he ", 2), (3, "राम", 1), (4, "plain", 0), (5, "bad answer", 0)], "query_id int, question string, messages int")
    good = '{"standalone_question": "who was Rama", "search_queries": [" rama ", "", "राम", "rama", "x", "y"], "answer_language": "Hinglish"}'
    answers = spark.createDataFrame([(2, good), (5, "not json"), (3, '{"search_queries": null}')], "query_id int, answer string")
    out = {r.query_id: r for r in planner.plans(q, answers).collect()}
    assert (out[1].queries, out[1].answer_language, out[1].rewritten) == (["राम कौन थे"], "Hindi", False)
    assert (out[2].standalone, out[2].queries, out[2].answer_language, out[2].rewritten) == ("who was Rama", ["who was Rama", "rama", "राम", "x"], "Hinglish", True)
    assert (out[4].answer_language, out[4].rewritten) == ("English", False)
    assert (out[5].queries, out[5].rewritten) == (["bad answer"], False)
    asks = {r.query_id: r.a for r in q.select("query_id", planner.needs_rewrite(F.col("question"), F.col("messages")).alias("a")).collect()}
    assert asks == {1: False, 2: True, 3: True, 4: True, 5: True}


def test_cache_key_is_the_engine_key(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "k"))
    rows = [('  What "is"\n DHARMA ', ["b", "a"], None), ("क्या", None, 3), ("q", [], 6)]
    df = spark.createDataFrame(rows, "q string, ids array<string>, k int")
    assert [r.h for r in df.select(planner.answer_key(F.col("q"), F.col("ids"), F.col("k")).alias("h")).collect()] == [lib.answer_key(*r) for r in rows]


def test_prompts(spark):
    hist = [("user", "a" * 2000), ("assistant", "b"), ("user", "c"), ("assistant", "d"), ("user", "e")]
    df = spark.createDataFrame([(hist,), ([],), (hist[:2],)], "h array<struct<role:string,content:string>>")
    out = [r.t for r in df.select(prompts.history_text(F.col("h")).alias("t")).collect()]
    assert out == ["assistant: b\nuser: c\nassistant: d\nuser: e", "(none)", "user: " + "a" * 1500 + "\nassistant: b"]
    hits = spark.createDataFrame([(0, 2, "T", None, 1, 2, "two"), (0, 1, "T", "S", 4, 4, "one")], "q int, n int, title string, section string, page_start int, page_end int, text string")
    assert prompts.context(hits, "q").first().context == "[1] T | S | p. 4\none\n\n[2] T | pp. 1-2\ntwo"
    turn = spark.range(1).select(prompts.user_turn(F.lit("q"), F.lit("p"), F.lit("orig"), F.lit("Hindi")).alias("a"), prompts.user_turn(F.lit("q"), F.lit("p"), F.lit(" q "), F.lit("Hindi")).alias("b"), prompts.nothing_found(F.lit("Hindi (x)")).alias("c"), prompts.nothing_found(F.lit("Hinglish")).alias("d")).first()
    assert "orig" in turn.a and "Asked as" not in turn.b and turn.c == prompts.NOTHING_FOUND["Hindi"] and turn.d == prompts.NOTHING_FOUND["English"]


def test_providers():
    waits = []
    calls = iter([ProviderError("busy", 503), ProviderError("busy", 429), None])

    def call():
        if e := next(calls):
            raise e
        return "ok"

    assert retrying(call, sleep=waits.append) == "ok" and len(waits) == 2
    assert is_transient(TimeoutError()) and is_transient(ProviderError("", 500)) and not is_transient(ProviderError("", 400))
    with pytest.raises(ProviderError):
        unit_rows([[1.0]], 2)

    class Counting(HashEmbedding):
        asked: list = []

        def embed(self, texts, task):
            self.asked += texts
            return super().embed(texts, task)

    embed = QueryEmbedder(Counting(8), size=2)
    a = embed(["x", "y", "x"])
    assert a[0] == a[2] and Counting.asked == ["x", "y"]
    embed(["x"])
    embed(["z", "w"])
    embed(["x"])
    assert Counting.asked == ["x", "y", "z", "w", "x"]


def test_failover():
    class Models:
        def __init__(self, **how):
            self.how, self.asked = how, []

        def stream(self, model, system, messages):
            self.asked.append(model)
            what = self.how[model]
            if isinstance(what, Exception):
                raise what
            if isinstance(what, float):
                time.sleep(what)
                what = "late"
            yield from what.split("|")

    busy = ProviderError("busy", 503)
    m = Models(a=busy, b="x|y", c="z")
    assert list(Failover(m, ("a", "b", "c")).stream("", [])) == ["x", "y"] and m.asked == ["a", "a", "b"]
    m = Models(a=0.5, b="fast")
    assert list(Failover(m, ("a", "b"), deadline=0.05).stream("", [])) == ["fast"]
    with pytest.raises(ProviderError, match="no model"):
        list(Failover(Models(a=busy), ("a",)).stream("", []))
    with pytest.raises(ProviderError, match="wrong"):
        list(Failover(Models(a=ProviderError("wrong", 400), b="x"), ("a", "b")).stream("", []))


def test_requests_are_checked():
    assert checked(" q ") == "q"
    for bad in (dict(question=" "), dict(question="x" * 2001), dict(question="q", top_k=21), dict(question="q", history=[{"role": "system", "content": ""}]), dict(question="q", history=[{"role": "user", "content": "x"}] * 41)):
        with pytest.raises(InvalidRequest):
            checked(**bad)
    now = [0.0]
    cache = TtlCache(2, 10, lambda: now[0])
    cache.put("a", 1)
    cache.put("b", 2)
    cache.put("c", 3)
    assert cache.get("a") is None and cache.get("b") == 2
    now[0] = 11
    assert cache.get("b") is None


def test_from_files_to_answers(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    (landing / "tea.txt").write_text("## Tea\n\nGreen tea is steeped for two minutes. Black tea is steeped for four.\fA second page about porcelain cups.")
    lib = Library(spark, str(tmp_path / "lib"))
    ids = lib.ingest(str(landing), "Book of Tea", language="en")
    assert len(ids) == 1 and lib.ingest(str(landing), "Book of Tea") == []
    assert lib.ready() == {"chunks": 1, "books": 1}
    book = lib.store.book(ids[0])
    assert (book.title, book.pages, book.chunks, book.ocr_pages, book.source_file) == ("Book of Tea", 2, 1, 0, "tea.txt")
    hit = lib.search("how long is green tea steeped")["sources"][0]
    assert (hit["n"], hit["section"], hit["page_start"], hit["page_end"]) == (1, "Tea", 1, 2)
    events = list(lib.stream("green tea"))
    assert [e["type"] for e in events][:1] == ["meta"] and events[-1]["type"] == "done" and any(e["type"] == "token" for e in events)
    again = list(lib.stream("Green   TEA"))
    assert [e["type"] for e in again] == ["meta", "token", "done"] and again[0]["cached"]
    assert lib.answer("green tea")["answer"] == "".join(e["text"] for e in events if e["type"] == "token")
    assert lib.search("tea", doc_ids=["other"])["sources"] == []
    assert lib.answer("tea", doc_ids=["other"])["answer"] == prompts.NOTHING_FOUND["English"]
    (landing / "more.md").write_text("## Coffee\n\nCoffee is roasted first.")
    first, second = lib.start_job(str(landing), "Drinks"), lib.start_job(str(landing), "Drinks")
    assert lib.job(first)["status"] == "running"
    job = lib.wait(first)
    assert lib.wait(second)["status"] == "completed" and None in {lib.job(first)["doc_id"], lib.job(second)["doc_id"]}
    assert job["status"] == "completed" and lib.ready()["books"] == 2
    assert [b.title for b in lib.books().collect()] == ["Book of Tea", "Drinks"]
    assert lib.wait(lib.start_job(str(tmp_path / "missing"), "x"))["status"] == "failed"
    assert lib.delete(ids[0]) and not lib.delete(ids[0]) and lib.ready() == {"chunks": 1, "books": 1}


def test_a_large_library_is_searched_from_its_folders(spark, tmp_path):
    """Nothing is held: postings of the asked terms, codes for all chunks and vectors for few, and the same answers."""
    landing = tmp_path / "in"
    landing.mkdir()
    topics = ["rivers run to the sea", "tea is steeped in water", "cups are made of porcelain", "mountains wear snow", "birds sing at dawn"]
    for k in range(10):
        (landing / f"{k}.txt").write_text("\f".join(f"## Part {j}\n\n{topics[(k + j) % 5]}, as page {j} of book {k} says at some length." for j in range(6)))
    held, large = Library(spark, str(tmp_path / "lib")), Library(spark, str(tmp_path / "lib"), Settings(held_chunks=0))
    ids = held.ingest(str(landing), "Books", language="en")
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "x.txt").write_text("Rivers freeze in winter.")
    held.ingest(str(tmp_path / "more"), "More", language="en")
    assert held.delete(ids[3]) and held.ready() == large.ready() == {"chunks": 55, "books": 10}
    for question in ("where do rivers run", "porcelain cups", "nothing of this kind"):
        one, two = held.search(question, top_k=8)["sources"], large.search(question, top_k=8)["sources"]
        assert [(s["n"], s["doc_id"], s["text"], s["score"]) for s in one] == [(s["n"], s["doc_id"], s["text"], s["score"]) for s in two] and one
        assert [s["text"] for s in held.search(question, doc_ids=ids[:2])["sources"]] == [s["text"] for s in large.search(question, doc_ids=ids[:2])["sources"]]
    points = large._index()[0]
    plan = dense_op.dense_topk(points, spark.createDataFrame([("0", [1] * 768)], "leg string, codes array<tinyint>"), "point_id", "leg", "codes", 9)._jdf.queryExecution().executedPlan().toString()
    assert "codes:array<tinyint>" in plan and "dense:array" not in plan
    assert all(len(r.codes) == 768 and max(map(abs, r.codes)) == 127 for r in points.select("codes").collect())


def test_a_closed_library_keeps_nothing_in_memory(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Something to read about rivers.")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    with Library(spark, str(tmp_path / "lib")) as lib:
        job = lib.start_job(str(tmp_path / "in"), "Rivers")
        lib.close()
        assert lib.job(job)["status"] == "completed"
        assert len(lib.search("rivers")["sources"]) == 1 and spark.sparkContext._jsc.getPersistentRDDs().size() > before
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    assert len(lib.search("rivers")["sources"]) == 1  # read anew
    lib.close()


def test_streams(spark, tmp_path, caplog):
    from datetime import datetime, timedelta

    from leafstack.operators.limits import decisions
    from leafstack.streaming.ingest import watch
    from leafstack.streaming.limiter import limited

    landing = tmp_path / "land"
    landing.mkdir()
    (landing / "a.txt").write_text("Something to read about rivers.")
    lib = Library(spark, str(tmp_path / "lib2"))
    for k in range(2):
        watch(lib, str(landing), str(tmp_path / f"cp{k}"), "Rivers").awaitTermination(120)
    assert lib.ready() == {"chunks": 1, "books": 1}
    # a file that is too large is refused by name; the batch that was written but not yet noted comes again and changes nothing
    small = Library(spark, str(tmp_path / "lib3"), Settings(max_upload_bytes=100))
    (landing / "b.txt").write_text("Too much to read. " * 20)
    with caplog.at_level("WARNING"):
        watch(small, str(landing), str(tmp_path / "cp9"), "Rivers").awaitTermination(120)
    assert "b.txt" in caplog.text and "360 bytes" in caplog.text and small.ready() == {"chunks": 1, "books": 1}
    assert [b.tag.endswith("/0") for b in small.store.batches()] == [True]
    for f in (tmp_path / "cp9" / "commits").glob("*0*"):
        f.unlink()
    small.delete(small.books().first().doc_id)
    watch(small, str(landing), str(tmp_path / "cp9"), "Rivers").awaitTermination(120)
    assert small.ready() == {"chunks": 0, "books": 0} and len(small.store.batches()) == 2

    start = datetime(2024, 1, 1)
    hits = spark.createDataFrame([(k % 3, k, start + timedelta(seconds=7 * k)) for k in range(60)], "client long, hit long, at timestamp")
    hits.repartition(1).sortWithinPartitions("hit").write.parquet(str(tmp_path / "hits"))
    stream = spark.readStream.schema(hits.schema).parquet(str(tmp_path / "hits"))
    query = limited(stream, 2, 60.0).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = {(r.client, r.hit): (r.admitted, r.retry_after) for r in decisions(hits, "client", "at", "hit", 2, 60).collect()}
    assert {(r.client, r.hit): (r.admitted, r.retry_after) for r in spark.table("limited").collect()} == batch
