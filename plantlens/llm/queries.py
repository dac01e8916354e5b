"""The numbered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.llm import centroids, embeddings, exact_dedup, jaccard, maxent, mixing, oracle, quality, sentencepiece_fst, spelling, substring, suffix_index, url_filter, weak_rules
from plantlens.llm.common import table

SENTENCEPIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


def held_out(remainder_of: int, held: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % remainder_of == held, F.lit(False))


def quality_model(docs: DataFrame, labels: DataFrame):
    """Model of ``labels.quality``, learned from rows that are not held out."""
    usable = labels.where(~held_out(5, 0)).select("doc_id", F.col("quality").alias("label"))
    return quality.fit(docs, usable)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = maxent.score_texts(table(spark, sf_dir, "documents"), ~held_out(7, 2))
    return scored.select("doc_id", held_out(7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_index.remove_earlier(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.score(docs, quality_model(docs, labels))
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = SENTENCEPIECE_MODEL) -> DataFrame:
    return sentencepiece_fst.encode_documents(table(spark, sf_dir, "documents"), sentencepiece_fst.read_model(model_path))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.drawn_words(table(spark, sf_dir, "documents"))
    each = mix.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select("doc_id", "size", "source_size", "target", "taken")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    outcomes = pages.join(labels, "page_id").select("url", "good")
    return url_filter.judge_urls(pages, outcomes, URL_RULES).drop("bound")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = weak_rules.judged(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality": op4_quality,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_mixing": op7_mixing,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_url_filter": op9_url_filter,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_centroids": op11_centroids,
    "op12_spelling": op12_spelling,
    "op13_quality_rules": op13_quality_rules,
}

ORACLE: dict[str, str] = {
    "op1_substring_dedup": oracle.OP1,
    "op3_suffix_dedup": oracle.OP3,
    "op6_exact_dedup": oracle.OP6,
    "op8_jaccard_join": oracle.OP8,
    "op9_url_filter": oracle.op9(URL_RULES),
    "op10_embedding_dedup": oracle.OP10,
    "op11_centroids": oracle.op11(centroids.DIM, centroids.SCALE, centroids.CLUSTERS, centroids.ROUNDS, centroids.SEED),
    "op12_spelling": oracle.OP12,
}
