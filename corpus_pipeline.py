"""From raw documents to packed training sequences in five stages.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; its result is written as
Parquet and read again before the next. All but the last return the columns of ``documents``.

In every stage an empty table gives an empty result, columns beyond those of ``documents`` pass through,
very long texts are taken whole, and rows that are repeats of each other are treated alike.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from colstride.llm import _shared, langid, mixing, neardup, packing, pii, queries

#: Language ID rejects texts without a letter, and those whose 3-grams are known at less than this part of
#: the share usual in the language they were given.
LEAST_FAMILIAR = 0.5
#: Near-duplicates: words of a shingle and similarity in percent.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; the model learns from these documents.

    A null text, an empty one and one without letters go, as do texts in a script or of letter sequences
    that no language here has; a null lang or id is no matter. Where no document has a lang to learn from,
    none can be told and all go.
    """
    name = "familiar" + "_" * max(map(len, docs.columns))  # longer than any
    found = langid.identify(docs, langid.train(docs), familiar=name)
    known = (found.lang_pred != langid.UNDETERMINED) & (found[name] >= LEAST_FAMILIAR)
    return found.where(known).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Null and empty texts are like nothing and stay, as do rows with a null id; rows that share an id go or
    stay together, and of rows with equal ids and equal texts one stays.
    """
    return neardup.first_of_each(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for private data; null and empty texts stay as they are."""
    return pii.redacted(docs, pii.session_key(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, repeats as rows of their own.

    Documents without words can give nothing and go; null is a source of its own; ties in the seeded order
    are settled by id and size.
    """
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 ids; a null or empty text is its end id alone."""
    return packing.pack(docs, queries.vocabulary(), end_id=2, capacity=4096)


STAGES = [
    ("language_id", language_id),
    ("minhash_dedup", near_dedup),
    ("pii", private_data),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Fitted models, keyed pseudonyms and seeded draws are beyond SQL. tests/llm holds the stages against planted
#: languages, brute force over all pairs, pseudonyms in plain Python, the sums of a plain water-filling, and
#: the tokenizer's ids; the kernels of language ID against sets of n-grams.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = _shared.read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{_shared.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}/{k}-{name}"
        with _shared.scratch(spark):  # what a stage stores on the way goes with it
            _shared.write(stage(spark, docs, sf_dir), path)
        docs = spark.read.parquet(path)
    return docs
