"""From a question and its history to the queries that are searched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafstack.config import DEFAULTS, Settings
from leafstack.functions.text import is_devanagari, strip

REWRITE_TYPE = "standalone_question string, search_queries array<string>, answer_language string"


def own_language(question: Column) -> Column:
    return F.when(is_devanagari(question), "Hindi").otherwise("English")


def needs_rewrite(question: Column, messages: Column) -> Column:
    """A question in Devanagari without history is searched as it is."""
    return ~((messages == 0) & is_devanagari(question))


def query_list(standalone: Column, rewrites: Column, s: Settings = DEFAULTS) -> Column:
    """The question first, then the rewrites that are not blank, each once, in order."""
    rest = F.filter(F.transform(F.coalesce(rewrites, F.array().cast("array<string>")), strip), lambda q: q != "")
    return F.slice(F.array_distinct(F.concat(F.array(standalone), rest)), 1, s.max_queries)


def plans(questions: DataFrame, rewritten: DataFrame | None = None, ident: str = "query_id", question: str = "question", messages: str = "messages", s: Settings = DEFAULTS) -> DataFrame:
    """ident, standalone, queries array, answer_language, rewritten boolean.

    ``rewritten`` (ident, answer string: JSON) is what a rewriting provider gave for the rows of ``needs_rewrite``; the rows
    can have it themselves as a column answer. A missing or unreadable answer leaves the question as it is.
    """
    if rewritten is not None:
        questions = questions.join(rewritten.select(ident, "answer"), ident, "left")
    elif "answer" not in questions.columns:
        questions = questions.withColumn("answer", F.lit(None).cast("string"))
    read, made = plan_columns(ident, question, messages, s)
    return questions.select(*read).select(*made)


def plan_columns(ident: str = "query_id", question: str = "question", messages: str = "messages", s: Settings = DEFAULTS) -> tuple[list[Column], list[Column]]:
    """The two steps of ``plans``, for rows that have an answer: what is read of a row, and what is made of it."""
    q = strip(F.col(question))
    read = [F.col(ident), q.alias("q"), needs_rewrite(q, F.col(messages)).alias("asks"), F.from_json("answer", REWRITE_TYPE).alias("r")]
    filled = lambda c: F.when(c != "", c)
    used = F.col("asks") & F.col("r").isNotNull() & F.coalesce(F.col("r.standalone_question"), F.to_json("r.search_queries"), F.col("r.answer_language")).isNotNull()
    standalone = F.when(used, strip(F.coalesce(filled(F.col("r.standalone_question")), F.col("q")))).otherwise(F.col("q"))
    made = [
        F.col(ident),
        standalone.alias("standalone"),
        query_list(standalone, F.when(used, F.col("r.search_queries")), s).alias("queries"),
        F.when(used, F.coalesce(filled(F.col("r.answer_language")), own_language(F.col("q")))).otherwise(own_language(F.col("q"))).alias("answer_language"),
        used.alias("rewritten"),
    ]
    return read, made


def answer_key(question: Column, doc_ids: Column, top_k: Column, s: Settings = DEFAULTS) -> Column:
    """The cache key of an answer: SHA-256 of the JSON list of folded question, sorted document ids and number of passages."""
    folded = F.regexp_replace(strip(F.lower(question)), r"(?U)\s+", " ")
    quoted = lambda t: F.substring(F.to_json(F.array(t)), 2, 1_000_000_000).substr(F.lit(1), F.length(F.to_json(F.array(t))) - 2)
    ids = F.array_join(F.transform(F.array_sort(F.coalesce(doc_ids, F.array().cast("array<string>"))), quoted), ", ")
    return F.sha2(F.concat(F.lit("["), quoted(folded), F.lit(", ["), ids, F.lit("], "), F.coalesce(top_k, F.lit(s.top_k)).cast("string"), F.lit("]")), 256)
