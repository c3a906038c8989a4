"""Hybrid retrieval: exact vector search, full-text ranking, reciprocal rank fusion, rerank, pre-filters."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketspark.operators.postings import MOST_LOOKED_UP, TermIndex, best
from docketspark.session import cut

METRICS = ("cosine", "l2", "ip")
PASS = 1024


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as a matrix of doubles; rows of another width are not a number."""
    lengths = pa.compute.list_value_length(column).fill_null(-1).to_numpy()
    out = np.full((len(column), dims), np.nan)
    right = lengths == dims
    if right.any():
        out[right] = column.filter(pa.array(right)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    return out


def scores(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """[query, row], greater is nearer: cosine similarity, minus the L2 distance, or the inner product."""
    product = queries @ rows.T
    if metric == "ip":
        return product
    if metric == "l2":
        return -np.sqrt(np.maximum((queries**2).sum(1)[:, None] + (rows**2).sum(1)[None, :] - 2 * product, 0))
    norms = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(rows, axis=1)[None, :]
    with np.errstate(invalid="ignore", divide="ignore"):
        return product / norms


def _nearest(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of each query's best rows, ties by id; distances of those that may be among the best are measured again, by differences."""
    found = scores(queries, rows, metric)
    found = np.where(np.isnan(found), -np.inf, found)
    if metric == "l2" and len(rows):
        some = np.argsort(-found, 1, kind="stable")[:, : k + 8]
        exact = -np.sqrt(((queries[:, None, :] - rows[some]) ** 2).sum(2))
        return np.where(np.isnan(exact), -np.inf, exact), ids[some]
    return found, np.broadcast_to(ids, found.shape)


def knn(rows: DataFrame, queries: DataFrame, k: int, dims: int, id_col: str = "id", vector: str = "embedding", metric: str = "cosine", block: int = PASS) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` nearest rows of every stated query, ties by id.

    Queries are read in passes of ``block``, each sent once and scored against all rows; every task keeps its own best ``k`` a query,
    so what is shuffled does not depend on the number of rows a task holds. Where there are several passes, each writes its
    result, so neither driver nor plan grows with the queries. Vectors of another width never match.
    """
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}")
    spark = rows.sparkSession
    given = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))

    def best_of(some: list) -> DataFrame:
        sent = spark.sparkContext.broadcast(([q for q, _ in some], np.array([v for _, v in some], np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            top_s, top_i = np.full((len(names), 0), 0.0), np.zeros((len(names), 0), np.int64)
            for batch in batches:
                ids = batch.column("id").to_numpy()
                for start in range(0, len(ids), 1024):
                    found, who = _nearest(q, matrix(batch.column("v").slice(start, 1024), dims), ids[start : start + 1024], k, metric)
                    top_s, top_i = np.concatenate([top_s, found], 1), np.concatenate([top_i, who], 1)
                    best_first = np.lexsort((top_i, -top_s), axis=1)[:, :k]
                    top_s, top_i = np.take_along_axis(top_s, best_first, 1), np.take_along_axis(top_i, best_first, 1)
            n = top_s.shape[1]
            keep = np.isfinite(top_s).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, n)[keep], pa.int64()), pa.array(top_i.ravel()[keep]), pa.array(top_s.ravel()[keep])], names=["query_id", "id", "score"])

        found = given.mapInArrow(run, "query_id long, id long, score double")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    done, some = [], []
    for r in queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")).toLocalIterator():
        if len(r["v"]) != dims:
            raise ValueError(f"query {r['id']} has {len(r['v'])} dimensions, the index has {dims}")
        some.append((r["id"], r["v"]))
        if len(some) == block:
            done.append(cut(best_of(some), "knn").inputFiles())
            some = []
    if not done:
        return best_of(some) if some else spark.createDataFrame([], "query_id long, id long, score double, rank int")
    if some:
        done.append(cut(best_of(some), "knn").inputFiles())
    return spark.read.schema("query_id long, id long, score double, rank int").parquet(*[path for files in done for path in files])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity as a column expression."""
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


# --- full text


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text; none of the empty text."""
    plain = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit("[a-z0-9]++"))


def term_counts(docs: DataFrame, terms: list[str], id_col: str, text_col: str) -> DataFrame:
    """(id, size, term, tf) for the asked terms only, counted in the scan: no token is built."""
    low = F.lower(F.col(text_col))
    found = [F.struct(F.lit(t).alias("term"), F.regexp_count(low, F.lit(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])")).alias("tf")) for t in sorted(set(terms))]
    return docs.select(F.col(id_col).alias("id"), n_tokens(F.col(text_col)).alias("size"), F.inline(F.array(*found)))


def bm25(docs: DataFrame, terms: list[str], k: int, id_col: str = "id", text_col: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score, rank) by BM25 without an index: one scan of the texts for the counts, which are written, not read twice."""
    counts = cut(term_counts(docs, terms, id_col, text_col), "counts")
    corpus = counts.groupBy("term").agg(F.count("*").alias("n"), F.avg("size").alias("mean"), F.count_if(F.col("tf") > 0).alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    # one row a term: as many as the query has terms
    scored = counts.filter("tf > 0").join(F.broadcast(corpus), "term").groupBy("id").agg(F.sum(part).alias("raw"))
    ranked = scored.select("id", F.round("raw", 9).alias("score")).orderBy(F.desc("score"), F.asc("id")).limit(k)
    return ranked.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), F.asc("id"))))


def reciprocal_ranks(dense: DataFrame, sparse: DataFrame, key: list[str], k: int = 60, weights: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """Weighted reciprocal rank fusion of two rankings; rows of either side stay, with both sides' signals."""
    if k < 1 or sum(weights) <= 0:
        raise ValueError("k is 1 at least and the weights' sum positive")
    left = dense.select(*key, F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"))
    right = sparse.select(*key, F.col("rank").alias("sparse_rank"), F.col("score").alias("sparse_score"))
    part = [F.coalesce(F.lit(w) / (F.lit(k) + F.col(r)), F.lit(0.0)) for w, r in zip(weights, ("dense_rank", "sparse_rank"), strict=True)]
    return left.join(right, key, "full_outer").withColumn("fused_score", part[0] + part[1])


def prefilter(chunks: DataFrame, slugs: list[str] | None = None, in_force: bool = True, documents: list | None = None, kinds: list[str] | None = None, years: tuple[int, int] | None = None, no_ocr: bool = False) -> DataFrame:
    """The filters that hold before any ranking; null years drop out of a year range."""
    keep = F.lit(True)
    if slugs:
        keep = keep & F.col("municipality_slug").isin(slugs)
    if in_force:
        keep = keep & (F.col("document_status") == "in_force")
    if documents:
        keep = keep & F.col("document_id").isin(documents)
    if kinds:
        keep = keep & F.col("chunk_type").isin(kinds)
    if years:
        keep = keep & F.col("year").between(*years)
    if no_ocr:
        keep = keep & ~F.coalesce(F.col("from_ocr"), F.lit(False))
    return chunks.filter(keep)


#: Where each column of what a citation needs comes from: chunk, document, municipality, section, page.
PROVENANCE = {
    "c": {"chunk_id": "id", "body": "body", "chunk_type": "chunk_type", "page_number": "page_number", "page_end": "page_end"},
    "d": {
        "document_id": "id", "document_title": "title", "bylaw_number": "bylaw_number", "document_status": "status",
        "consolidation_date": "consolidation_date", "last_amendment_date": "last_amendment_date", "effective_date": "effective_date",
    },
    "m": {"municipality_slug": "canonical_slug", "municipality_name": "name"},
    "s": {"section_number": "section_number", "section_path": "full_path", "section_heading": "heading"},
    "p": {"from_ocr": "was_ocred", "extraction_confidence": "extraction_confidence", "page_width": "width", "page_height": "height"},
}


def with_provenance(chunks: DataFrame, documents: DataFrame, municipalities: DataFrame, sections: DataFrame, pages: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Chunks with the 21 columns of provenance, and ``extra`` ones of their own: every retrieval projects these and no others.

    A chunk without a document goes; municipality, section and page may be missing. A page is told by document and number. Only the
    columns named here are read. Chunks are moved while they are narrow, the shortest columns joined first; a municipality meets its
    documents, which are fewer.
    """

    def part(rows: DataFrame, letter: str, *keys: str) -> DataFrame:
        own = {v: k for k, v in PROVENANCE[letter].items()}
        return rows.select(*[F.col(c).alias(own[c]) for c in own], *[F.col(k).alias(f"_{letter}_{k}") for k in keys])

    at = (F.col("_c_document_id") == F.col("_p_document_id")) & (F.col("page_number") == F.col("_p_page_number"))
    rows = part(chunks, "c", "document_id", "section_id", *extra).join(part(pages, "p", "document_id", "page_number"), at, "left")
    rows = rows.join(part(sections, "s", "id"), F.col("_c_section_id") == F.col("_s_id"), "left")
    placed = part(documents, "d", "municipality_id").join(part(municipalities, "m", "id"), F.col("_d_municipality_id") == F.col("_m_id"), "left")
    joined = rows.join(placed, F.col("_c_document_id") == F.col("document_id"))
    return joined.select(*[name for columns in PROVENANCE.values() for name in columns], *[F.col(f"_c_{k}").alias(k) for k in extra])


def in_collection(vectors: DataFrame, name, column: str = "collection") -> DataFrame:
    """The vectors of one collection; where they are stored by collection, the others' files are not read."""
    return vectors.filter(F.col(column) == name)


def is_citable() -> Column:
    """Whether a chunk can carry a citation of a clause: it has a city, a title and a section."""
    filled = [F.coalesce(F.col(c), F.lit("")) != "" for c in ("municipality_slug", "document_title", "section_number")]
    return filled[0] & filled[1] & filled[2]


def is_current() -> Column:
    return F.coalesce(F.col("document_status") == "in_force", F.lit(False))


def rerank(pool: DataFrame, score: Column, k: int, by: list[str], tie: str) -> DataFrame:
    """The best ``k`` by a reranker's score. Scales are never mixed: where it gives a question's pool some null, the whole pool
    keeps the fused order."""
    scored = pool.withColumn("rerank_score", score)
    failed = F.max(F.col("rerank_score").isNull()).over(W.partitionBy(*by))
    final = scored.withColumn("failed", failed).withColumn("final_score", F.when(F.col("failed"), F.col("fused_score")).otherwise(F.col("rerank_score")))
    order = W.partitionBy(*by).orderBy(F.desc("final_score"), F.asc(tie))
    return final.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("failed")


def term_overlap(terms: Column, body: Column) -> Column:
    """The default reranker: the share of the question's terms that the body has."""
    return F.size(F.array_intersect(terms, tokens(body))) / F.size(terms)


def fused_rankings(vectors: DataFrame, index: TermIndex, questions: DataFrame, dims: int, vector: str = "embedding", pool: int = 50, rrf_k: int = 60, allowed: DataFrame | None = None) -> DataFrame:
    """Dense and sparse top ``pool`` of every question, independent of each other, fused: the best ``pool`` with both sides' signals.

    ``vectors``: id and vector; ``questions``: query_id, the vector (or null) and terms array<string>; ``allowed``: id.
    """
    rows = vectors if allowed is None else vectors.join(allowed.select("id"), "id", "left_semi")
    dense = knn(rows, questions.select(F.col("query_id").alias("id"), vector).filter(F.col(vector).isNotNull()), pool, dims, "id", vector)
    sparse = index.search(questions.select("query_id", F.explode("terms").alias("term")), pool, allowed)
    return best(reciprocal_ranks(dense, sparse, ["query_id", "id"], rrf_k), pool, "fused_score")


def hybrid(
    chunks: DataFrame, vectors: DataFrame, index: TermIndex, questions: DataFrame, dims: int, vector: str = "embedding", pool: int = 50, top: int = 5, rrf_k: int = 60, filtered: bool = False, reranker: Callable[[Column, Column], Column] | None = term_overlap
) -> DataFrame:
    """Every question's best ``top``: both searches, fused, reranked; all signals kept.

    ``chunks``: id, body, filtered before by ``prefilter`` (then say ``filtered``, and neither search leaves them).
    ``reranker``: a score from (terms, body), null where it has none; None keeps the fused order.
    """
    fused = fused_rankings(vectors, index, questions, dims, vector, pool, rrf_k, chunks if filtered else None).withColumnRenamed("rank", "fused_rank")
    if reranker is None:
        return best(fused.withColumn("final_score", F.col("fused_score")), top, "final_score")
    fused = cut(fused, "fused")
    few = fused.select("id").distinct().limit(MOST_LOOKED_UP + 1).collect()
    wanted = chunks.filter(F.col("id").isin([r["id"] for r in few])) if len(few) <= MOST_LOOKED_UP else chunks  # few bodies are looked up, not scanned for
    bodies = wanted.select("id", "body").join(fused, "id").join(questions.select("query_id", "terms"), "query_id")
    return rerank(bodies, reranker(F.col("terms"), F.col("body")), top, ["query_id"], "id").drop("body", "terms")
