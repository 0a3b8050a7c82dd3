"""Finds the passages for a set of questions and writes what a text generator is to be sent for each.

    python -m jobs.question_sheets --documents DIR --questions DIR --vectors DIR --output DIR --name SET [--config jobs/question_sheets.json]

Questions are searched by keywords and by vectors, both legs fused by rank. The job writes

    hits/question_set=SET      a row for each passage found, with rank and score
    sheets/question_set=SET    a row for each question: the prompt with its numbered passages, or the reply that nothing was found

A run overwrites the partitions of its own set and no others, so it can be repeated, and sets are kept beside each other.
"""

from __future__ import annotations

import argparse
import json
import logging
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from leafstack.config import DEFAULTS
from leafstack.functions.text import excerpt
from leafstack.operators.fusion import hybrid_search, sources
from leafstack.operators.sparse import postings
from leafstack.plans import prompts

log = logging.getLogger("question_sheets")
CONFIG = Path(__file__).with_suffix(".json")

HIT = "item_id long, doc_id long, n int, score double, question_set string"
SHEET = "item_id long, hits int, prompt string, reply string, question_set string"


def _put(rows: DataFrame, path: str, name: str) -> int:
    """Overwrite the partition of this set; the number of rows. A set without rows leaves an empty partition behind."""
    seen = Observation()
    counted = rows.observe(seen, F.count("*").alias("n"))
    counted.write.mode("overwrite").parquet(f"{path}/question_set={name}")
    return seen.get["n"]


def build(spark: SparkSession, documents: str, questions: str, vectors: str, output: str, name: str, settings: dict | None = None) -> dict[str, int]:
    """Write hits and sheets of the question set ``name``; their numbers.

    documents (doc_id, text, lang, source), questions (item_id, text), vectors (vec_id, embedding) of documents and of
    questions by their ids. Rows without an id are not searched and not asked.
    """
    if not name or not all(c.isalnum() or c in "-_." for c in name):
        raise ValueError(f"a set is named by letters, digits, '-', '_' and '.': {name!r}")
    settings = json.loads(CONFIG.read_text()) | (settings or {})
    s = replace(DEFAULTS, top_k=settings["top_k"], prefetch_k=settings["prefetch_k"])
    docs = spark.read.parquet(documents).where("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")
    asked = spark.read.parquet(questions).where("item_id IS NOT NULL").select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    vector = spark.read.parquet(vectors).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    total = docs.count()
    log.info("read %d documents of %s and %d questions of %s", total, documents, asked.count(), questions)

    of = lambda ids, key: ids.select(key).join(vector.select(F.col("vec_id").alias(key), "embedding"), key)
    index = postings(docs, "doc_id", F.col("text"), s)
    found = hybrid_search(index, of(docs, "doc_id"), asked, of(asked, "item_id"), total, "doc_id", "item_id", F.col("text"), s=s)
    n = {"hits": _put(found.select("item_id", "doc_id", F.col("rank").alias("n"), "score"), f"{output}/hits", name)}

    best = read(spark, output, "hits", name).select("item_id", "doc_id", F.col("n").alias("rank"), "score")
    section = F.when(F.col("lang") == "en", "").otherwise(F.coalesce("lang", F.lit("")))
    payload = docs.select("doc_id", F.col("source").alias("title"), section.alias("section"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), excerpt(F.col("text"), settings["excerpt_chars"]).alias("text"))
    shown = prompts.context(sources(best, payload, "item_id", "doc_id"), "item_id").join(best.groupBy("item_id").agg(F.count("*").cast("int").alias("hits")), "item_id")
    language = F.lit(settings["language"])
    turn = prompts.user_turn(F.col("text"), F.col("context"), F.col("text"), language)
    sheets = asked.join(shown, "item_id", "left").select("item_id", F.coalesce("hits", F.lit(0)).alias("hits"), turn.alias("prompt"), F.when(F.col("hits").isNull(), prompts.nothing_found(language)).alias("reply"))
    n["sheets"] = _put(sheets, f"{output}/sheets", name)
    log.info("wrote %d hits and %d sheets of set %s to %s", n["hits"], n["sheets"], name, output)
    return n


def read(spark: SparkSession, output: str, table: str, name: str | None = None) -> DataFrame:
    """``hits`` or ``sheets``, of one set or of all."""
    rows = spark.read.schema({"hits": HIT, "sheets": SHEET}[table]).option("basePath", f"{output}/{table}")
    return rows.parquet(f"{output}/{table}" + (f"/question_set={name}" if name else ""))


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for arg in ("documents", "questions", "vectors", "output", "name"):
        parser.add_argument(f"--{arg}", required=True)
    parser.add_argument("--config", default=str(CONFIG))
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("question_sheets").getOrCreate()
    try:
        build(spark, args.documents, args.questions, args.vectors, args.output, args.name, json.loads(Path(args.config).read_text()))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
