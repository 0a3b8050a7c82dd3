"""The queries of the training-data operators, with their production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafstack.llm import cuckoo_dedup, decontaminate, kdtree_shards, language_id, license_scan, odd_sketches, repair_grammar, simhash, speculative_bpe, token_counts, toxicity, whitening
from leafstack.llm._common import documents

TOKENIZER = "word_bpe_49k.json"
TOXIC = 0.3


def op1_cuckoo_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row of equal texts stays, for every document."""
    return cuckoo_dedup.exact_duplicates(documents(spark, sf_dir))


def _remainder(of: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """Fitted on the labelled rows of ``docs`` that are not held out."""
    return toxicity.train(docs.where(_remainder(4) != 2), spark.read.parquet(f"{sf_dir}/labels.parquet").where(_remainder(4) != 2))


def op2_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every document."""
    docs = documents(spark, sf_dir)
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op3_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = documents(spark, sf_dir)
    model = language_id.train(docs.where(_remainder(3) != 1))
    found = language_id.predict(docs, model)
    return found.select("doc_id", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_transducer_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    return token_counts.count_tokens(documents(spark, sf_dir), speculative_bpe.tokenizer_file(TOKENIZER))


def op5_patience_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document, with their coverage and place."""
    return license_scan.find_licenses(documents(spark, sf_dir))


def op6_simhash_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; links at two differing bits or fewer."""
    classes = simhash.linked_classes(documents(spark, sf_dir), budget=2, n=3)
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op7_kdtree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty shards of near equal bytes."""
    placed = kdtree_shards.shards(documents(spark, sf_dir), count=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items they contain, also with other numbers, units or names."""
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, decoded text and their digests for every document."""
    return speculative_bpe.round_trip(documents(spark, sf_dir), speculative_bpe.tokenizer_file(TOKENIZER), keep=("doc_id",))


def op10_repair_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids as read back from the grammar blocks that hold the corpus in doc_id order."""
    return repair_grammar.write_and_read(documents(spark, sf_dir), speculative_bpe.tokenizer_file(TOKENIZER))


def op11_range_finder_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole vector on the first 32 components, scaled to unit variance."""
    return whitening.whitening(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=32)


def op12_odd_sketch_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of every document: five-word shingles, similarity 0.85."""
    return odd_sketches.near_duplicates(documents(spark, sf_dir), n=5, percent=85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cuckoo_dedup": op1_cuckoo_dedup,
    "op2_counterfactual_toxicity": op2_counterfactual_toxicity,
    "op3_cross_parsing_language": op3_cross_parsing_language,
    "op4_transducer_token_counts": op4_transducer_token_counts,
    "op5_patience_license_scan": op5_patience_license_scan,
    "op6_simhash_trie_join": op6_simhash_trie_join,
    "op7_kdtree_shards": op7_kdtree_shards,
    "op8_template_decontamination": op8_template_decontamination,
    "op9_speculative_bpe": op9_speculative_bpe,
    "op10_repair_token_blocks": op10_repair_token_blocks,
    "op11_range_finder_whitening": op11_range_finder_whitening,
    "op12_odd_sketch_minhash": op12_odd_sketch_minhash,
}

SQL: dict[str, str] = {
    "op1_cuckoo_dedup": """
WITH normal AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS bare
  FROM documents
), ranked AS (
  SELECT doc_id, bare,
         first_value(doc_id) OVER (PARTITION BY bare ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY bare) AS group_size
  FROM normal
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM ranked
""",
    "op12_odd_sketch_minhash": """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), tokens AS (
  SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM words
), runs AS (
  SELECT doc_id, n, pos, CASE WHEN n < 5 THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
    ELSE string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) END AS g
  FROM tokens
), rows AS (
  SELECT DISTINCT doc_id, g FROM runs WHERE pos <= greatest(n - 4, 1)
), sizes AS (
  SELECT doc_id, count(g) AS n_shingles FROM documents LEFT JOIN rows USING (doc_id) GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM rows a JOIN rows b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
  WHERE 100 * n >= 85 * (a.n_shingles + b.n_shingles - n)
), edges AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, e.y FROM reached r JOIN edges e ON e.x = r.other
), roots AS (
  SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN roots USING (doc_id)
""",
}
