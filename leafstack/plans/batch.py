"""Rewriting and answering for tables of questions: a distinct request is one call of a provider, and calls are made in tasks.

A call that fails is told in its own row and stops no other. What providers said is written once and read from there, so
that no later action, and no lost executor after that, asks them again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafstack.config import DEFAULTS, Settings
from leafstack.plans import planner, prompts
from leafstack.plans.providers import ExtractiveGeneration, Failover, RewriteProvider, retrying
from leafstack.scratch import written


def _said(rows: DataFrame, inputs: list[str], wanted: Column, call: Callable[..., str], in_flight: int) -> DataFrame:
    """``rows`` with said string and failed string: what ``call`` gave for the row's inputs, or its error; both null where not ``wanted``.

    Rows are written first: they are read for the calls and again for the answers, and may have taken a search to make.
    Equal inputs are one call. Calls are slow and rows are small, so requests are dealt to as many tasks as shuffles have,
    which adaptive execution would join by size.
    """
    key = F.sha2(F.to_json(F.struct(*inputs)), 256)
    keyed = written(rows.drop("said", "failed").withColumn("_key", F.when(wanted, key)), "asked")
    once = keyed.where("_key IS NOT NULL").groupBy("_key").agg(*(F.first(c).alias(c) for c in inputs))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def one(request: tuple) -> tuple[str | None, str | None]:
        try:
            return call(*request), None
        except Exception as e:  # noqa: BLE001  the row tells it
            return None, str(e) or type(e).__name__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(in_flight) as pool:
            for b in batches:
                out = list(pool.map(one, zip(*(b.column(c).to_pylist() for c in inputs))))
                yield pa.RecordBatch.from_arrays([b.column("_key"), *(pa.array([o[k] for o in out], pa.string()) for k in (0, 1))], names=["_key", "said", "failed"])

    heard = written(once.repartition(tasks, "_key").mapInArrow(run, "_key string, said string, failed string"), "said")
    return keyed.join(heard, "_key", "left").drop("_key")


def answers(sheets: DataFrame, generator: Failover | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """``sheets`` with answer string and error string.

    sheets: prompt string, language string, reply string (what is said without a model, null to ask one), and perhaps history
    array<struct<role, content>>, the turns before the prompt in the form of ``prompts.generation_history``. A row without
    prompt and reply has neither answer nor error. The columns answer, error, said and failed are replaced where they exist.
    """
    generator = generator or Failover(ExtractiveGeneration(), deadline=s.first_token_seconds)
    inputs = ["prompt", "language", *(["history"] if "history" in sheets.columns else [])]
    system = prompts.SYSTEM

    def call(prompt: str, language: str | None, history: list[dict] | None = None) -> str:
        messages = [{"role": m["role"], "content": m["content"]} for m in history or []]
        return "".join(generator.stream(system.replace("{language}", language or "English"), [*messages, {"role": "user", "content": prompt}]))

    asked = _said(sheets.drop("answer", "error"), inputs, F.col("reply").isNull() & F.col("prompt").isNotNull(), call, s.embed_in_flight)
    return asked.withColumn("answer", F.coalesce("reply", "said")).withColumnRenamed("failed", "error").drop("said")


def rewritten_plans(questions: DataFrame, rewriter: RewriteProvider, ident: str = "query_id", s: Settings = DEFAULTS) -> DataFrame:
    """The plans of questions (``ident``, question, messages int, history string or null), as ``planner.plans`` makes them.

    A rewriter is asked about those of ``planner.needs_rewrite``. Where it fails, or says nothing that can be read, the
    question is searched as it is.
    """
    filled = questions.withColumn("history", F.coalesce("history", F.lit("(none)"))).drop("answer")
    attempts, wait = s.attempts, s.max_wait_seconds

    def call(history: str, question: str) -> str:
        return retrying(lambda: rewriter.rewrite(history, question.strip()), attempts, wait)

    wanted = F.col("question").isNotNull() & planner.needs_rewrite(F.col("question"), F.col("messages"))
    asked = _said(filled, ["history", "question"], wanted, call, s.embed_in_flight)
    return planner.plans(asked.withColumnRenamed("said", "answer"), ident=ident, s=s)
