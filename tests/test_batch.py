"""Answers and plans for tables of questions."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime, timedelta

from leafstack.config import Settings
from leafstack.plans import batch
from leafstack.plans.prompts import SYSTEM
from leafstack.plans.providers import Failover, ProviderError

SHEET = "id int, prompt string, language string, reply string, history array<struct<role string, content string>>"


def echo():
    """A provider made inside a function goes to tasks by value."""

    class Echo:
        """Says what it was sent, by which model, and something no other call says."""

        def stream(self, model, system, messages):
            prompt = messages[-1]["content"]
            if "refuse" in prompt:
                raise ProviderError("refused", 400)
            if "busy" in prompt and model != "third":
                raise ProviderError("busy", 503)
            if "silent" in prompt:
                return
            if "odd" in prompt:
                raise ValueError
            yield json.dumps([model, system, messages, uuid.uuid4().hex])

    return Echo()


def said(rows):
    return {r.id: (json.loads(r.answer) if (r.answer or "").startswith("[") else r.answer, r.error) for r in rows}


def test_answers_of_all_kinds(spark):
    talk = [("user", "who"), ("model", "he")]
    rows = [(1, "a", "Hindi", None, talk), (2, "busy", None, None, None), (3, "refuse", "English", None, []), (4, "x", "English", "nothing found", None), (5, None, "English", None, None), (6, "silent", "English", None, None), (7, "odd", "English", None, None)]
    out = said(batch.answers(spark.createDataFrame(rows, SHEET), Failover(echo())).collect())
    model, system, messages, _ = out[1][0]
    assert model == "primary" and system == SYSTEM.replace("{language}", "Hindi")
    assert messages == [{"role": "user", "content": "who"}, {"role": "model", "content": "he"}, {"role": "user", "content": "a"}]
    assert out[2][0][0] == "third" and out[2][0][1] == SYSTEM.replace("{language}", "English") and out[2][1] is None
    assert out[3] == (None, "refused") and out[4] == ("nothing found", None) and out[5] == (None, None)
    assert out[6] == ("", None) and out[7] == (None, "ValueError")


def test_equal_requests_are_one_call_and_are_not_made_again(spark):
    rows = [(k, "same" if k % 3 else "other", "English", None, [("user", "t")] if k % 2 else None) for k in range(60)]
    made = batch.answers(spark.createDataFrame(rows, SHEET).repartition(7), Failover(echo()))
    out = said(made.collect())
    assert len(out) == 60 and len({a[3] for a, _ in out.values()}) == 4  # two prompts, with and without a talk
    assert said(made.collect()) == out


def test_columns_that_clash_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "a", "English", None, "old", "old", "old", "old", "kept")] * 2, "id int, prompt string, language string, reply string, answer string, error string, said string, failed string, mine string")
    out = batch.answers(rows, Failover(echo())).collect()
    assert len(out) == 2 and {(r.error, r.mine) for r in out} == {(None, "kept")} and out[0].answer == out[1].answer != "old"
    empty = batch.answers(spark.createDataFrame([], SHEET))
    assert empty.collect() == [] and {"answer", "error"} < set(empty.columns)


def rewriter():
    """Fails, is silent or says words for some questions."""

    class Rewriter:
        def rewrite(self, history, question):
            if question == "refuse":
                raise ProviderError("refused", 400)
            if question == "blank":
                return ""
            if question == "words":
                return "I would rather say it in words"
            return json.dumps({"standalone_question": f"{question} after {history}", "search_queries": ["one", " ", "one", "two"], "answer_language": ""})

    return Rewriter()


def test_plans_of_a_table(spark):
    rows = [(1, " who was he ", 2, "user: Rama"), (2, "राम कौन थे", 0, None), (3, "refuse", 0, None), (4, "words", 0, None), (5, "blank", 1, "user: x"), (6, None, 0, None), (7, "राम", 1, "user: y"), (8, "refuse", 0, None)]
    questions = spark.createDataFrame(rows, "query_id int, question string, messages int, history string")
    out = {r.query_id: r for r in batch.rewritten_plans(questions, rewriter(), s=Settings(attempts=1)).collect()}
    assert (out[1].standalone, out[1].queries, out[1].answer_language, out[1].rewritten) == ("who was he after user: Rama", ["who was he after user: Rama", "one", "two"], "English", True)
    assert (out[2].queries, out[2].answer_language, out[2].rewritten) == (["राम कौन थे"], "Hindi", False)
    assert all((out[k].queries, out[k].rewritten) == ([q], False) for k, q in ((3, "refuse"), (4, "words"), (5, "blank"), (8, "refuse")))
    assert (out[6].standalone, out[6].rewritten) == (None, False)
    assert (out[7].standalone, out[7].answer_language) == ("राम after user: y", "Hindi")
    assert batch.rewritten_plans(questions.limit(0), rewriter()).collect() == []


def test_a_clock_that_is_put_forward_does_not_shorten_a_window(spark, tmp_path):
    from leafstack.operators.limits import decisions
    from leafstack.sources.tables import stream_path
    from leafstack.streaming.limiter import limited

    start = datetime(2024, 3, 10, 6, 30, tzinfo=UTC)
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        hits = spark.createDataFrame([(k % 2, k, start + timedelta(minutes=5 * k)) for k in range(24)], "client long, hit long, at timestamp")
        hits.coalesce(1).write.parquet(str(tmp_path / "hits"))
        stream = spark.readStream.schema(hits.schema).parquet(stream_path(str(tmp_path / "hits")))
        query = limited(stream, 2, 1500.0).writeStream.format("memory").queryName("forward").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        batch_rows = {r.hit: (r.admitted, r.retry_after) for r in decisions(hits, "client", "at", "hit", 2, 1500).collect()}
        assert {r.hit: (r.admitted, r.retry_after) for r in spark.table("forward").collect()} == batch_rows
        assert {a for a, _ in batch_rows.values()} == {True, False}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
