"""The opN queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundloom.llm import bpe, html_main, images, mixing, pii, prefixes, quality, repeats, scoring, secrets, simhash, urls, whitening
from groundloom.llm.common import load
from groundloom.llm.oracles import ORACLES


def op1_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.drop_repeats(load(spark, sf_dir, "documents")))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract_main(load(spark, sf_dir, "pages"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(load(spark, sf_dir, "documents")))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal(load(spark, sf_dir, "documents")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_quality(load(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_left_words", "kept")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(load(spark, sf_dir, "pages"))


def op7_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no pictures: each embedding, 8 x 8 values, is drawn as one of 64 x 64 pixels."""
    vectors = load(spark, sf_dir, "embeddings")
    pictures = vectors.select(F.col("vec_id").alias("image_id"), F.lit(64).alias("height"), F.lit(64).alias("width"), images.from_vectors(F.col("embedding")).alias("pixels"))
    return images.image_copies(pictures).withColumnRenamed("image_id", "vec_id")


def op8_simhash_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_copies(load(spark, sf_dir, "documents")))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digest(bpe.round_trip(docs))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.conversation_trie(load(spark, sf_dir, "conversations"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(whitening.whiten(load(spark, sf_dir, "embeddings")))


def op13_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


QUERIES = {
    "op1_repeat_removal": op1_repeat_removal,
    "op2_main_text": op2_main_text,
    "op3_secret_scan": op3_secret_scan,
    "op4_personal_data": op4_personal_data,
    "op5_quality_rules": op5_quality_rules,
    "op6_url_filter": op6_url_filter,
    "op7_image_copies": op7_image_copies,
    "op8_simhash_copies": op8_simhash_copies,
    "op9_source_mix": op9_source_mix,
    "op10_byte_pairs": op10_byte_pairs,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_whitening": op12_whitening,
    "op13_quality_score": op13_quality_score,
}

__all__ = ["ORACLES", "QUERIES"]
