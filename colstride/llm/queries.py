"""The queries of this subpackage as the driver registers them: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from . import embeddings, langid, mixing, neardup, packing, pii, quality, sharding, token_fst, toxicity
from ._shared import crc_fold, read
from .oracle import ORACLE_SQL


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), width=3, percent=85)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    return sharding.place(docs, [f"shard-{k:03d}" for k in range(256)])


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), cosine=0.95)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file; it lies at the same place on every worker."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", (crc_fold(F.col("doc_id")) == 2).alias("held_out"), "score", "predicted")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary(), end_id=2, capacity=4096)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), pii.session_key(spark))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_fst.count_tokens(read(spark, sf_dir, "documents"), vocabulary(), limit=2048)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", (crc_fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_sharding": op2_sharding,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_packing": op6_packing,
    "op7_pii": op7_pii,
    "op8_token_counts": op8_token_counts,
    "op9_language_id": op9_language_id,
    "op10_mixing": op10_mixing,
}
