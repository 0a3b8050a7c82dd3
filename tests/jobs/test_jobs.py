"""The jobs on copies of the tables: two runs over growing input, repeated runs, failures, odd rows, command lines."""

from __future__ import annotations

import json
import logging
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import passages, question_sheets
from leafstack.functions.quality import page_quality
from leafstack.operators.chunking import chunks

ROOT = Path(__file__).resolve().parents[2]
SCHEMA = "doc_id long, text string, lang string, source string"


def kept(df):
    return sorted(map(tuple, df.collect()), key=repr)


def from_scratch(docs):
    """The passages of documents, all at once."""
    trusted = docs.where(~page_quality(F.col("text")).needs_ocr)
    found = chunks(trusted.select("doc_id", F.lit(1).alias("page"), "text")).join(docs.select("doc_id", "lang"), "doc_id")
    return kept(found.select("doc_id", "lang", "chunk_index", "text", "page_start", "page_end", "section"))


def put(df, folder, name):
    """One more file in a folder, as another process would leave it."""
    tmp = folder.parent / f"tmp-{folder.name}-{name}"
    df.coalesce(1).write.parquet(str(tmp))
    folder.mkdir(exist_ok=True)
    shutil.move(next(tmp.glob("*.parquet")), folder / f"{name}.parquet")


def paths(tmp_path):
    return str(tmp_path / "docs"), str(tmp_path / "out"), str(tmp_path / "checkpoint")


def test_passages_follow_a_growing_table(spark, data, tmp_path, caplog):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", "source")
    where = paths(tmp_path)
    with caplog.at_level(logging.INFO, "passages"):
        put(docs.where("doc_id % 3 = 0"), tmp_path / "docs", "a")
        put(docs.where("doc_id % 3 = 1"), tmp_path / "docs", "b")
        first = passages.update(spark, *where, {"files_per_batch": 1})
        assert first["batches"] == 2 and kept(passages.passages(spark, where[1])) == from_scratch(docs.where("doc_id % 3 < 2"))
        # new documents; new versions of old ones: another text, one that cannot be trusted, another language
        changed = docs.where("doc_id % 30 = 0").withColumn("text", F.concat(F.lit("Added in front of it. "), "text")).withColumn("lang", F.lit("xx"))
        gone = docs.where("doc_id % 30 = 1").withColumn("text", F.lit("too short"))
        put(docs.where("doc_id % 3 = 2").unionByName(changed).unionByName(gone), tmp_path / "docs", "c")
        second = passages.update(spark, *where)
    now = docs.where("doc_id % 30 > 1").unionByName(changed).unionByName(gone)
    assert second["batches"] == 1 and second["documents"] == docs.where("doc_id % 3 = 2 OR doc_id % 30 < 2").count()
    assert kept(passages.passages(spark, where[1])) == from_scratch(now)
    listed = {r.doc_id: r for r in passages.documents(spark, where[1]).collect()}
    assert len(listed) == docs.count() and listed[30].lang == "xx" and listed[31].needs_ocr and listed[31].chars == 9
    assert f"read {docs.where('doc_id % 3 < 2').count()} new rows" in caplog.text and "wrote" in caplog.text

    before = kept(passages.passages(spark, where[1]))
    assert passages.update(spark, *where) == {"batches": 0, "read": 0, "documents": 0, "passages": 0}
    # a run that ended after it had written and before it had said so: its batch comes again
    (tmp_path / "checkpoint" / "commits" / "2").unlink()
    (tmp_path / "checkpoint" / "commits" / ".2.crc").unlink(missing_ok=True)
    files = lambda: sorted(p.parent.name for p in (tmp_path / "out").rglob("*.parquet"))
    there = files()
    again = passages.update(spark, *where)
    assert again == second and files() == there and kept(passages.passages(spark, where[1])) == before
    by_lang = {p.name for p in (tmp_path / "out" / "passages").glob("batch=*/lang=*")}
    assert "lang=xx" in by_lang and spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_passages_of_odd_rows(spark, tmp_path):
    where = paths(tmp_path)
    good = "A sentence of a text that is long enough to be trusted. "
    rows = [(1, None, "en", "s"), (2, "", "en", "s"), (None, good, "en", "s"), (3, good, None, None), (4, good, "en", "s"), (4, good, "en", "s"), (4, "Z" + good, "de", "t"), (5, good * 3000, "en", "s")]
    put(spark.createDataFrame(rows, SCHEMA).withColumn("batch", F.lit("clash")), tmp_path / "docs", "a")
    passages.update(spark, *where)
    found = passages.passages(spark, where[1])
    assert {r.doc_id for r in found.collect()} == {3, 4, 5} and found.where("doc_id = 4").collect()[0].text.startswith("ZA")
    assert found.where("doc_id = 3").first().lang is None and found.where("doc_id = 5").count() > 100
    assert {r.doc_id: r.needs_ocr for r in passages.documents(spark, where[1]).collect()} == {1: True, 2: True, 3: False, 4: False, 5: False}
    assert passages.passages(spark, str(tmp_path / "nothing")).count() == 0
    put(spark.createDataFrame([], SCHEMA), tmp_path / "empty", "a")
    passages.update(spark, str(tmp_path / "empty"), str(tmp_path / "out2"), str(tmp_path / "checkpoint2"))
    assert passages.passages(spark, str(tmp_path / "out2")).count() == 0


def sheets(spark, data, out, name="benchmark", **settings):
    return question_sheets.build(spark, *(f"{data}/{t}.parquet" for t in ("documents", "benchmark", "embeddings")), out, name, settings)


def test_sheets_can_be_repeated_and_sets_stay_apart(spark, data, tmp_path, caplog):
    out = str(tmp_path / "out")
    with caplog.at_level(logging.INFO, "question_sheets"):
        n = sheets(spark, data, out)
    items = spark.read.parquet(f"{data}/benchmark.parquet").count()
    assert n == {"hits": 6 * items, "sheets": items} and "read 200 documents" in caplog.text
    first = kept(question_sheets.read(spark, out, "sheets"))
    assert all(s[2].startswith("Passages:\n\n[1] ") and s[2].count("\n\n[") == s[1] for s in first)
    sheets(spark, data, out)
    assert kept(question_sheets.read(spark, out, "sheets")) == first
    sheets(spark, data, out, "short", top_k=2, language="Hindi")
    assert kept(question_sheets.read(spark, out, "sheets", "benchmark")) == first
    assert question_sheets.read(spark, out, "hits").count() == 8 * items
    assert question_sheets.read(spark, out, "sheets", "short").first().prompt.endswith("Answer in Hindi.")
    with pytest.raises(ValueError, match="named by letters"):
        sheets(spark, data, out, "a/b")


def test_sheets_of_odd_rows(spark, tmp_path):
    put(spark.createDataFrame([(1, "red fox", "en", "s"), (2, None, None, None), (None, "red", "en", "s"), (3, "", "en", "s")], SCHEMA), tmp_path / "d", "a")
    put(spark.createDataFrame([(1, "a red one?"), (2, None), (None, "red"), (3, "unheard")], "item_id long, text string"), tmp_path / "q", "a")
    put(spark.createDataFrame([(3, None), (9, [1.0, 0.0])], "vec_id long, embedding array<float>"), tmp_path / "v", "a")
    n = question_sheets.build(spark, *(str(tmp_path / x) for x in "dqv"), str(tmp_path / "out"), "odd")
    assert n == {"hits": 1, "sheets": 3}
    found = {r.item_id: r for r in question_sheets.read(spark, str(tmp_path / "out"), "sheets").collect()}
    assert "[1] s | p. 1\nred fox" in found[1].prompt and found[1].reply is None
    assert found[2].hits == found[3].hits == 0 and found[3].prompt is None and found[3].reply.startswith("Sorry")


def run(tmp_path, job, config, *args):
    (tmp_path / "config.json").write_text(json.dumps(config))
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", *args, "--config", str(tmp_path / "config.json")], cwd=ROOT, capture_output=True, text=True, timeout=300, env={**__import__("os").environ, "PYSPARK_SUBMIT_ARGS": "--conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 --master local[2] pyspark-shell"})
    assert done.returncode == 0, done.stderr[-3000:]
    return done.stderr


def test_command_lines(spark, data, tmp_path):
    said = run(tmp_path, "passages", {"chunk_size": 300}, "--documents", f"{data}/documents.parquet", "--output", str(tmp_path / "p"), "--checkpoint", str(tmp_path / "c"))
    assert "read 200 new rows" in said
    texts = [r.text for r in passages.passages(spark, str(tmp_path / "p")).collect()]
    assert texts and max(map(len, texts)) <= 300
    given = [x for t, p in (("documents", "documents"), ("questions", "benchmark"), ("vectors", "embeddings")) for x in (f"--{t}", f"{data}/{p}.parquet")]
    said = run(tmp_path, "question_sheets", {"top_k": 3}, *given, "--output", str(tmp_path / "s"), "--name", "b-1")
    assert "wrote" in said and question_sheets.read(spark, str(tmp_path / "s"), "hits", "b-1").agg(F.max("n")).first()[0] == 3
