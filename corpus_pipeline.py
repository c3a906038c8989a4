"""A training-data pipeline over ``documents``: each stage calls one operator and its decisions take effect.

Every stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``. Null text is empty text in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketspark.llm.bpe import encode
from docketspark.llm.common import prepare
from docketspark.llm.decontaminate import contaminated, find_passages
from docketspark.llm.exact_dedup import drop_copies
from docketspark.llm.language_id import UNKNOWN, fit, identify
from docketspark.llm.minhash import drop_near_copies
from docketspark.session import cut, ship, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be told (null, or without a letter) go."""
    prepare(spark)
    ship(spark)
    return identify(docs, fit(docs)).filter(F.col("lang_pred") != UNKNOWN).select("row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies one row stays, with the least doc_id."""
    prepare(spark)
    ship(spark)
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least one word in twenty lies in a benchmark passage go."""
    prepare(spark)
    ship(spark)
    return find_passages(docs, table(spark, sf_dir, "benchmark")).filter(~contaminated()).select("row.*")


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What stays, encoded: number of tokens, digests of the ids and of the decoded text."""
    import public_tokenizers

    prepare(spark)
    ship(spark)
    found = encode(docs, public_tokenizers.path("word_bpe_49k.json"), ("n_tokens", "ids_sha256", "decoded_sha256"), carry=["doc_id"])
    return found.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("bpe", bpe),
]

ORACLE_SQL = None  # language models and tokenizers are beyond SQL; tests/llm holds it against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
