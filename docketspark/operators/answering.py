"""What becomes of questions: retrieval among what is in force, a second retrieval for those that found nothing, conflicts, outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketspark.operators.documents import answer
from docketspark.operators.postings import TermIndex, english
from docketspark.operators.relational import conflict_groups
from docketspark.operators.retrieval import is_current
from docketspark.session import cut

MOST_NAMED = 5


def resolve(index: TermIndex, chunks: DataFrame, asked: DataFrame, k: int = 5, own_terms: bool = False) -> DataFrame:
    """query_id, outcome, n_chunks, best (chunk id), n_conflicts, outdated: one row for every question of ``asked`` (query_id, term).

    ``chunks``: id, municipality_slug, section_number, document_id, document_title, document_status.
    All questions go through the index among the chunks in force. Those, and only those, that find nothing go through it again
    without that filter: what they find then says that a rule exists and is out of force. A question's chunks conflict where two
    documents in force speak to one section of one city.
    """
    asked = cut(asked.select("query_id", "term").distinct(), "asked")
    first = cut(index.search(asked, k, chunks.filter(is_current()).select("id"), own_terms=own_terms).select("query_id", "id", "rank"), "first")
    missing = cut(asked.join(first.select("query_id").distinct(), "query_id", "left_anti"), "missing")
    second = first.limit(0) if missing.isEmpty() else cut(index.search(missing, k, own_terms=own_terms).select("query_id", "id", "rank"), "second")
    conflicts = conflict_groups(first.join(chunks, "id"), ["query_id", "municipality_slug", "section_number"], "document_id", "document_title", "rank")
    named = F.struct("rank", F.concat(F.coalesce("document_title", F.lit("Untitled")), F.lit(" ("), F.coalesce("document_status", F.lit("unknown")), F.lit(")")).alias("name"))
    old = second.join(chunks, "id").filter(~is_current()).groupBy("query_id").agg(F.array_sort(F.collect_list(named)).alias("found"))  # k at most
    outdated = old.select("query_id", F.slice(F.array_distinct(F.transform("found", lambda x: x["name"])), 1, MOST_NAMED).alias("outdated"))
    top = first.groupBy("query_id").agg(F.count("*").alias("n_chunks"), F.min_by("id", "rank").alias("best"))
    speak = conflicts.groupBy("query_id").agg(F.count("*").alias("n_conflicts"))
    rows = asked.select("query_id").distinct().join(top, "query_id", "left").join(speak, "query_id", "left").join(outdated, "query_id", "left")
    outcome = F.when(F.col("n_conflicts") > 0, "conflicting_amendments").when(F.col("n_chunks") > 0, "answered").when(F.col("outdated").isNotNull(), "only_outdated").otherwise("no_relevant")
    return rows.select("query_id", outcome.alias("outcome"), F.coalesce("n_chunks", F.expr("0L")).alias("n_chunks"), "best", F.coalesce("n_conflicts", F.expr("0L")).alias("n_conflicts"), F.coalesce("outdated", F.array().cast("array<string>")).alias("outdated"))


def ask(spark: SparkSession, documents: DataFrame, question: str, top: int = 5, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """A question in words: its best excerpts by English stems (rank, chunk_id, score, body), and the answer made of them, verified.

    ``path``: where the index stays. Without a word that the index knows nothing is found.
    """
    index = TermIndex(documents.select(id_col, text_col), ("ask",), id_col, text_col, english, documents, path)
    terms = index.clauses([(0, question)]).filter("not negated").select("query_id", "term")
    found = cut(index.search(terms, top, own_terms=True), "asked")
    ids = [r["id"] for r in found.select("id").collect()]  # top at most
    bodies = documents.filter(F.col(id_col).isin(ids)).select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).join(found, "id")
    none = F.lit(None)
    retrieved = bodies.select(F.col("query_id").alias("question_id"), "rank", F.col("id").alias("chunk_id"), "body", F.concat(F.lit("Document "), F.col("id").cast("string")).alias("document_title"), none.cast("string").alias("section_number"), none.cast("int").alias("page_number"))
    asked = spark.createDataFrame([(0, question)], "question_id long, question string")
    return bodies.select("rank", F.col("id").alias("chunk_id"), "score", F.substring("body", 1, 160).alias("body")), answer(asked, retrieved)
