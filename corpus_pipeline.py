"""A corpus pipeline of five stages, each over all that the one before kept; every stage is written and read again.

Toxic documents go; of each group of near duplicates one stays; personal data is replaced by pseudonyms; sources are
mixed, which repeats documents of small ones; the last stage encodes what is left and returns digests of the ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import jaccard_join, mixing, pii, toxicity
from lexmill.llm.common import all_columns, fresh, written
from lexmill.llm.queries import bpe_digests, pii_key, toxicity_model


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier does not call toxic, all columns kept.

    Rows are judged each by their own whole texts; a null or empty text has the score of the bias, which is that of a
    clean document. Null ids, repeated rows and columns of any name pass; no rows give no rows.
    """
    return toxicity.without_toxic(docs, toxicity_model(spark, sf_dir))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document with the least id, all columns kept.

    Texts without words (null counts as empty) are duplicates of equal ones only. Of repeated rows one stays; rows with a
    null id stay; different texts under one id are judged each. No rows give no rows.
    """
    return jaccard_join.distinct_documents(docs)


def with_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced and n_chars counted anew.

    A null text stays null, with the n_chars it has; an empty one stays empty. Null ids, repeated rows and columns of
    any name pass; no rows give no rows.
    """
    new = pii.pseudonymised(docs, pii_key(spark), count_col=fresh(docs, "values"))
    return new.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*all_columns(docs))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources as often as the mixture asks for, all columns kept.

    A null source is a source of its own; documents of sources without words, as null and empty texts alone are, stay
    once. Null ids, repeated rows and columns of any name pass; no rows give no rows.
    """
    return mixing.mixed_documents(docs)


def encoded_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each document: doc_id, its number of ids, and digests of the ids and of the bytes they decode to.

    A null text counts as empty and has no ids. Null ids and repeated rows pass; other columns are not read; no rows
    give no rows.
    """
    return bpe_digests(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", without_near_duplicates),
    ("pii", with_pseudonyms),
    ("mixing", mixed_sources),
    ("bpe", encoded_ids),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
