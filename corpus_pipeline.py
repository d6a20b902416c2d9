"""Training-data pipeline over ``documents``: each stage reads what its predecessor wrote.

Run with ``run(spark, sf_dir)``; the stages can also be called one by one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm import bpe, decontaminate, language, pii, simhash
from strideframe.llm.common import keep, read


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier can tell; those without a letter go, also where nothing is labelled."""
    model = language.train(docs.where(F.coalesce(~language.held_out(), F.lit(True))))
    if not model.labels:  # no language can be told, only whether there is any
        return docs.where(F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"\p{L}"))
    tagged, label, _ = language.tag(docs, model)
    return tagged.where(F.col(label) != "und").drop(*[c for c in tagged.columns if c not in docs.columns])


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies.

    Codewords of fingerprints give candidates; two texts are linked only if their
    five-word shingles are alike to 0.8.
    """
    return simhash.one_of_near_copies(docs, minima=True)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, whole or edited."""
    return decontaminate.clean_rows(docs, read(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked."""
    return pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and ids of every text."""
    return bpe.encode_frame(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", known_language),
    ("near_copies", one_of_near_copies),
    ("benchmark", without_benchmark),
    ("personal_data", without_personal_data),
    ("tokens", tokens),
]


#: Learned weights have no SQL; tests/llm holds the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
