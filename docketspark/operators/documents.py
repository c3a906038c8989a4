"""Documents' life: tables lifted off pages, versions of the index, edges rebuilt, questions answered end to end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketspark.functions import plugins
from docketspark.functions import text as T
from docketspark.operators import answers as A
from docketspark.operators import verify as Q


def lookup(rows: DataFrame, key: str, value) -> DataFrame:
    """The row of a unique key; the filter reaches the scan."""
    return rows.filter(F.col(key) == value).limit(1)


def override(old: Column, given: Column) -> Column:
    """A person's entry where it is not blank, else what is there."""
    return F.coalesce(F.nullif(T.strip(given), F.lit("")), old)


def merge_metadata(first: DataFrame, second: DataFrame, key: str, lists: tuple[str, ...] = ()) -> DataFrame:
    """Fields of the first where it has them, else of the second; lists are united, the first's items before."""
    b = second.select(key, *[F.col(c).alias(f"_{c}") for c in second.columns if c != key])
    rows = first.join(b, key, "full_outer")
    none = F.array().cast("array<string>")
    return rows.select(key, *[(F.array_union(F.coalesce(c, none), F.coalesce(f"_{c}", none)) if c in lists else F.coalesce(c, f"_{c}")).alias(c) for c in first.columns if c != key])


def rebuild_edges(existing: DataFrame, detected: DataFrame) -> DataFrame:
    """Detected edges anew; those that a person entered stay."""
    by_hand = existing.filter(F.col("detected_by") == "human")
    key = ["parent", "child", "relation_type"]
    return by_hand.unionByName(detected.join(by_hand.select(*key), key, "left_anti").select(*existing.columns))


def distinct_citations(citations: DataFrame, by: str, *order: str) -> DataFrame:
    """Citations without repeats of chunk and the first 80 characters of the quote; the first one in ``order`` stays, which has to be a whole order; nulls stand last."""
    w = W.partitionBy(by, "chunk_id", F.substring("quote", 1, 80)).orderBy(*map(F.asc_nulls_last, order))
    return citations.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def next_version(collections: DataFrame, model: str, chunking: int) -> DataFrame:
    """The index version that a new collection of this model and chunking gets."""
    mine = (F.col("model") == model) & (F.col("chunking_version") == chunking)
    return collections.agg((F.coalesce(F.max(F.when(mine, F.col("index_version"))), F.lit(0)) + 1).alias("index_version"))


def to_embed(chunks: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Distinct contents that the model has no vector of: the others are reused by their hash."""
    done = vectors.filter(F.col("model") == model).select("content_hash")
    return chunks.withColumn("content_hash", T.content_hash(F.col("body"))).dropDuplicates(["content_hash"]).join(done, "content_hash", "left_anti")


# fixed values: the instructions of an answer
INSTRUCTIONS = "Answer from the excerpts only. Cite each statement as [S#]. Reply with one JSON object: answer, citations (source_id, quote)."


def prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit(INSTRUCTIONS + "\n\n"), context, F.lit("\n\nQuestion: "), question)


def answer(questions: DataFrame, retrieved: DataFrame, load: Callable[[], plugins.Generator] = plugins.extractive_generator) -> DataFrame:
    """From retrieved chunks to verified answers: question_id, answer, n_valid, n_invalid, abstain, reason, outcome.

    ``questions``: question_id, question. ``retrieved``: question_id, rank, chunk_id, body, document_title, section_number,
    page_number. A reply that can't be read is no answer.
    """
    context = A.context_blocks(retrieved)
    asked = questions.join(context, "question_id", "left")
    reply = plugins.generate(prompt(F.col("question"), F.coalesce("context", F.lit(""))), load)
    replied = asked.withColumn("reply", reply).withColumn("r", F.from_json(T.json_object(F.col("reply")), "answer string, citations array<struct<source_id: int, quote: string>>"))
    given = replied.select(F.col("question_id").alias("answer_id"), F.coalesce("r.answer", F.lit("")).alias("answer"), F.size(F.coalesce("source_map", F.array().cast("array<struct<source_id: int, chunk_id: int>>"))).alias("n_chunks"), F.col("r").isNotNull().alias("generated"), "source_map", "r.citations")
    claims = given.select("answer_id", F.inline("citations"))
    sources = given.select("answer_id", F.inline("source_map"))
    checked = Q.check_claims(claims, sources, retrieved.select("chunk_id", "body").dropDuplicates(["chunk_id"]))
    report = Q.verify_answers(given.drop("source_map", "citations"), checked)
    outcome = F.when(F.col("n_chunks") == 0, "no_relevant").when(~F.col("generated"), "generation_unavailable").when(F.col("abstain"), "unverified").otherwise("answered")
    return report.select(F.col("answer_id").alias("question_id"), "answer", "n_valid", "n_invalid", "abstain", "reason", outcome.alias("outcome"))
