"""Retrieval over ``embeddings`` and ``documents``: a chunk is a document, its vector the embedding of the same number."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketspark.operators import fulltext
from docketspark.operators import retrieval as R
from docketspark.operators.ann import VectorIndex
from docketspark.operators.answering import resolve
from docketspark.operators.postings import english
from docketspark.plans.registry import query
from docketspark.session import cut, spread, table

DIMS, TERMS = 64, ["the", "tion", "ther", "that"]


def _knn_sql(score: str) -> str:
    return f"""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 20 = 0),
       s AS (SELECT query_id, vec_id AS id, {score} AS raw FROM q CROSS JOIN (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)),
       r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, id) AS rank FROM s)
       SELECT query_id, id, round(raw, 6) AS score, rank FROM r WHERE rank <= 10"""


def _knn(metric):
    def run(spark, d):
        rows = table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
        return R.knn(rows, rows.filter("id % 20 = 0"), 10, DIMS, metric=metric).select("query_id", "id", F.round("score", 6).alias("score"), "rank")

    run.__doc__ = f"The ten nearest rows by {metric} of every twentieth row."
    return run


query(_knn_sql("list_cosine_similarity(qv, v)"), "knn_cosine", rank="INTEGER")(_knn("cosine"))
query(_knn_sql("-list_distance(qv, v)"), "knn_l2", rank="INTEGER")(_knn("l2"))
query(_knn_sql("list_inner_product(qv, v)"), "knn_ip", rank="INTEGER")(_knn("ip"))


@query(_knn_sql("list_cosine_similarity(qv, v)").replace("AS v FROM embeddings", "AS v FROM embeddings WHERE label = 3"), rank="INTEGER")
def knn_in_collection(spark, d):
    """The ten nearest rows of one collection; labels stand for collections."""
    rows = table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    return R.knn(R.in_collection(rows, 3, "label"), rows.filter("id % 20 = 0"), 10, DIMS).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("""SELECT doc_id, coalesce(lang, '') <> '' AND coalesce(source, '') <> '' AND doc_id % 7 <> 0 AS citable, coalesce(lang = 'en', false) AS current FROM documents""")
def citable_chunks(spark, d):
    """Documents as chunks: which can carry a citation of a clause, which are in force."""
    i = F.col("doc_id")
    chunks = table(spark, d, "documents").select("doc_id", F.col("lang").alias("municipality_slug"), F.col("source").alias("document_title"), F.when(i % 14 == 0, "").when(i % 7 != 0, (i % 7).cast("string")).alias("section_number"), F.when(F.col("lang") == "en", "in_force").when(F.col("lang") == "fr", "repealed").alias("document_status"))
    return chunks.select("doc_id", R.is_citable().alias("citable"), R.is_current().alias("current"))


@query()
def knn_ivf(spark, d):
    """The same by an index of lists and residual product codes; its recall against the exact search is tested."""
    vectors = table(spark, d, "embeddings")
    rows = vectors.withColumnRenamed("vec_id", "id")
    found = VectorIndex(rows.select("id", "embedding"), DIMS, ("embeddings", d), source=vectors).search(rows.filter("id % 20 = 0"), 10)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


_TOKENS = "list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: t <> '')"
_BM25 = f"""t AS (SELECT doc_id AS id, len({_TOKENS}) AS size, unnest([{', '.join(f"'{t}'" for t in TERMS)}]) AS term, {_TOKENS} AS ts FROM documents),
       c AS (SELECT id, size, term, len(list_filter(ts, lambda x: x = term)) AS tf FROM t),
       g AS (SELECT term, count(*) AS n, avg(size) AS mean, count(*) FILTER (WHERE tf > 0) AS df FROM c GROUP BY 1),
       s AS (SELECT id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 9) AS score FROM c JOIN g USING (term) WHERE tf > 0 GROUP BY 1),
       bm AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s QUALIFY row_number() OVER (ORDER BY score DESC, id) <= 50)"""


def text_index(spark, d):
    """The index over ``documents``: written by the first query that needs it, read by the others."""
    docs = table(spark, d, "documents")
    return R.TermIndex(spread(docs.select("doc_id", "text")), ("documents", d), "doc_id", source=docs)


@query("""WITH t AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: t <> '')) AS term FROM documents)
       SELECT term, count(DISTINCT doc_id) AS df, count(*) AS n FROM t GROUP BY 1""")
def term_index(spark, d):
    """The index is built: every term with the rows and the places it occurs in."""
    return text_index(spark, d).blocks.groupBy("term").agg(F.sum("n").alias("df"), F.sum("total").alias("n"))


@query(f"WITH {_BM25} SELECT id, round(score, 6) AS score, rank FROM bm", rank="INTEGER")
def bm25_topk(spark, d):
    """The top 50 documents by BM25, from the index."""
    asked = spark.range(1).select(F.col("id").alias("query_id"), F.explode(F.array(*map(F.lit, TERMS))).alias("term"))
    return text_index(spark, d).search(asked, 50).select("id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_BM25} SELECT id, round(score, 6) AS score, rank FROM bm", rank="INTEGER")
def bm25_scan(spark, d):
    """The same without an index, by one scan of the texts."""
    return R.bm25(spread(table(spark, d, "documents").select("doc_id", "text")), TERMS, 50, "doc_id").select("id", F.round("score", 6).alias("score"), "rank")


@query("""WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: t <> '') AS ts FROM documents)
       SELECT doc_id AS id, len(list_filter(ts, lambda x: x IN ('the', 'that'))) AS tf FROM t ORDER BY tf DESC, id LIMIT 50""")
def sparse_tf_topk(spark, d):
    """The top 50 documents by term frequency."""
    counts = R.term_counts(spread(table(spark, d, "documents").select("doc_id", "text")), ["the", "that"], "doc_id", "text").groupBy("id").agg(F.sum("tf").alias("tf"))
    return counts.orderBy(F.desc("tf"), F.asc("id")).limit(50)


def questions(spark, d):
    """Every twentieth row as a question: its vector, and the six rarest terms of its text that another text has."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = vectors.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    terms = text_index(spark, d).rarest(asked, 6).groupBy("query_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))  # six at most
    return vectors, cut(asked.join(terms, "query_id", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>"))), "questions")


def _fused_sql(allowed: str) -> str:
    return f"""tk AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents),
       po AS (SELECT doc_id, term, count(*) AS tf FROM tk GROUP BY ALL),
       sz AS (SELECT doc_id, len({_TOKENS}) AS size FROM documents),
       st AS (SELECT count(*) AS n, avg(size) AS mean FROM sz),
       df AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
       ok AS ({allowed}),
       qs AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 20 = 0),
       qt AS (SELECT query_id, term, df FROM qs JOIN po ON doc_id = query_id JOIN df USING (term) WHERE df >= 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY df, term) <= 6),
       s AS (SELECT query_id, po.doc_id AS id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 9) AS score
             FROM qt JOIN po USING (term) JOIN sz ON sz.doc_id = po.doc_id CROSS JOIN st WHERE po.doc_id IN (SELECT id FROM ok) GROUP BY 1, 2),
       sr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 50),
       d AS (SELECT query_id, vec_id AS id, list_cosine_similarity(qv, embedding::DOUBLE[]) AS score FROM qs CROSS JOIN embeddings WHERE vec_id IN (SELECT id FROM ok)),
       dn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 50),
       f AS (SELECT coalesce(dn.query_id, sr.query_id) AS query_id, coalesce(dn.id, sr.id) AS id, dn.rank AS dense_rank, sr.rank AS sparse_rank, coalesce(0.5::DOUBLE / (60 + dn.rank), 0) + coalesce(0.5::DOUBLE / (60 + sr.rank), 0) AS fused
             FROM dn FULL OUTER JOIN sr ON dn.query_id = sr.query_id AND dn.id = sr.id),
       p AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, id) <= 50)"""


@query(f"WITH {_fused_sql('SELECT vec_id AS id FROM embeddings UNION SELECT doc_id FROM documents')} SELECT query_id, id, dense_rank, sparse_rank, round(fused, 9) AS fused FROM p", dense_rank="INTEGER", sparse_rank="INTEGER")
def rrf_fusion(spark, d):
    """Two rankings fused for every question; rows of one side stay."""
    vectors, asked = questions(spark, d)
    found = R.fused_rankings(vectors, text_index(spark, d), asked, DIMS)
    return found.select("query_id", "id", "dense_rank", "sparse_rank", F.round("fused_score", 9).alias("fused"))


def hybrid_answers(spark, d, vectors, asked, index=None):
    """The filters, searches, fusion and rerank of ``hybrid_retrieve`` for the questions given; ``index``: one that is open already."""
    docs = table(spark, d, "documents")
    chunks = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("body"), F.col("lang").alias("municipality_slug"), F.when(F.col("source") != "src3", "in_force").alias("document_status"), F.col("n_chars").alias("year"))
    found = R.hybrid(R.prefilter(chunks, slugs=["en", "fr"], years=(100, 20_000)), vectors, index or text_index(spark, d), asked.filter(F.size("terms") > 0), DIMS, filtered=True)
    return found.select("query_id", "id", "dense_rank", "sparse_rank", F.round("fused_score", 9).alias("fused"), F.round("final_score", 6).alias("final"), "rank")


@query(f"""WITH {_fused_sql("SELECT doc_id AS id FROM documents WHERE lang IN ('en', 'fr') AND source <> 'src3' AND n_chars BETWEEN 100 AND 20000")},
       tm AS (SELECT query_id, list(term) AS terms FROM qt GROUP BY 1),
       z AS (SELECT p.*, len(list_intersect(terms, {_TOKENS})) / len(terms)::DOUBLE AS final FROM p JOIN tm USING (query_id) JOIN documents ON doc_id = id)
       SELECT query_id, id, dense_rank, sparse_rank, round(fused, 9) AS fused, round(final, 6) AS final, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, id) AS rank FROM z
       QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY final DESC, id) <= 5""", dense_rank="INTEGER", sparse_rank="INTEGER", rank="INTEGER")
def hybrid_retrieve(spark, d):
    """Every question: filters, dense and sparse top 50, fusion, rerank, top 5 with all signals kept."""
    return hybrid_answers(spark, d, *questions(spark, d))


@query(f"""WITH tk AS (SELECT doc_id, unnest({_TOKENS}) AS term, generate_subscripts({_TOKENS}, 1) AS p FROM documents),
       df AS (SELECT term, count(DISTINCT doc_id) AS df FROM tk GROUP BY 1),
       qt AS (SELECT query_id, term FROM (SELECT DISTINCT vec_id AS query_id, term, df FROM embeddings JOIN tk ON doc_id = vec_id JOIN df USING (term) WHERE vec_id % 20 = 0 AND df >= 2)
              QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY df, term) <= 2),
       h AS (SELECT query_id, doc_id AS id, term, p FROM qt JOIN tk USING (term)),
       a AS (SELECT query_id, id, p, term, lag(p) OVER w AS p0, lag(term) OVER w AS t0 FROM h WINDOW w AS (PARTITION BY query_id, id ORDER BY p)),
       s AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (p - p0)), 9) AS score FROM a WHERE t0 <> term GROUP BY 1, 2)
       SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s
       WHERE query_id IN (SELECT query_id FROM qt GROUP BY 1 HAVING count(*) = 2) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10""", rank="INTEGER")
def cover_density(spark, d):
    """Every twentieth document's two rarest terms as a question: the ten texts in which both stand nearest together, from the index."""
    index = text_index(spark, d)
    asked = index.rarest(table(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id")), 2)
    both = asked.join(asked.groupBy("query_id").agg(F.count("*").alias("n")).filter("n = 2"), "query_id")
    return index.cover_density(both, 10, own_terms=True).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


WEB = ['"of the" that -is OR der', "the -that", '-the -der', '"in the" OR "of the" OR "de la"', "and", '"the and"']


@query(rf"""WITH h AS (SELECT doc_id, ' ' || regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') || ' ' AS hay FROM documents)
       SELECT 0::BIGINT AS query_id, doc_id FROM h WHERE (contains(hay, ' of the ') AND contains(hay, ' that ') AND NOT contains(hay, ' is ')) OR contains(hay, ' der ')
       UNION ALL SELECT 1, doc_id FROM h WHERE contains(hay, ' the ') AND NOT contains(hay, ' that ')
       UNION ALL SELECT 2, doc_id FROM h WHERE NOT contains(hay, ' the ') AND NOT contains(hay, ' der ')
       UNION ALL SELECT 3, doc_id FROM h WHERE contains(hay, ' in the ') OR contains(hay, ' of the ') OR contains(hay, ' de la ')
       UNION ALL SELECT 4, doc_id FROM h WHERE contains(hay, ' and ')
       UNION ALL SELECT 5, doc_id FROM h WHERE contains(hay, ' the and ')""")
def web_match(spark, d):
    """Six web-style queries at once, from the index: intersections, phrases by adjacent positions, negations, unions."""
    return text_index(spark, d).match(list(enumerate(WEB))).select("query_id", F.col("id").alias("doc_id"))


@query(r"""WITH h AS (SELECT doc_id, ' ' || regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') || ' ' AS hay FROM documents)
       SELECT doc_id FROM h WHERE (contains(hay, ' of the ') AND contains(hay, ' that ') AND NOT contains(hay, ' is ')) OR contains(hay, ' der ')""")
def fulltext_match(spark, d):
    """Documents that satisfy a web-style query, by a scan of the texts."""
    return table(spark, d, "documents").filter(fulltext.matches(F.col("text"), WEB[0])).select("doc_id")


@query()
def english_ranking(spark, d):
    """The same by English stems without stop words; tested against a brute-force search."""
    docs = table(spark, d, "documents")
    index = R.TermIndex(spread(docs.select("doc_id", "text")), ("documents", d), "doc_id", term_of=english, source=docs)
    asked = index.rarest(table(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id")), 2)
    return index.cover_density(asked, 10, own_terms=True)


@query(f"""WITH tk AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents),
       po AS (SELECT doc_id, term, count(*) AS tf FROM tk GROUP BY ALL), sz AS (SELECT doc_id, len({_TOKENS}) AS size FROM documents), st AS (SELECT count(*) AS n, avg(size) AS mean FROM sz), df AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
       qt AS (SELECT vec_id AS query_id, term, df FROM embeddings JOIN po ON doc_id = vec_id JOIN df USING (term) WHERE vec_id % 20 = 0 AND df >= 2 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY df, term) <= 2),
       b AS (SELECT query_id, doc_id AS id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 9) AS score FROM qt JOIN po USING (term) JOIN sz USING (doc_id) CROSS JOIN st GROUP BY 1, 2),
       m AS (SELECT doc_id AS id, lang, source, CASE WHEN lang = 'en' AND source <> 'src3' THEN 'in_force' WHEN lang = 'fr' THEN 'superseded' ELSE 'repealed' END AS status FROM documents),
       f AS (SELECT query_id, id, lang, source, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b JOIN m USING (id) WHERE status = 'in_force' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5),
       c AS (SELECT query_id, count(*) AS n_conflicts FROM (SELECT query_id FROM f GROUP BY query_id, lang, source HAVING count(DISTINCT id) >= 2) GROUP BY 1),
       g AS (SELECT query_id, id, status, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b JOIN m USING (id) WHERE query_id NOT IN (SELECT query_id FROM f) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5),
       o AS (SELECT query_id, string_agg('doc ' || id || ' (' || status || ')', '; ' ORDER BY rank) AS outdated FROM g WHERE status <> 'in_force' GROUP BY 1),
       t AS (SELECT query_id, count(*) AS n_chunks, arg_min(id, rank) AS best FROM f GROUP BY 1)
       SELECT query_id, CASE WHEN n_conflicts > 0 THEN 'conflicting_amendments' WHEN n_chunks > 0 THEN 'answered' WHEN outdated IS NOT NULL THEN 'only_outdated' ELSE 'no_relevant' END AS outcome, coalesce(n_chunks, 0) AS n_chunks, best, coalesce(n_conflicts, 0) AS n_conflicts, coalesce(outdated, '') AS outdated
       FROM (SELECT DISTINCT query_id FROM qt) LEFT JOIN t USING (query_id) LEFT JOIN c USING (query_id) LEFT JOIN o USING (query_id)""")
def question_outcomes(spark, d):
    """Every twentieth document's two rarest terms as a question: answered, in conflict, found only out of force by a second retrieval, or not found."""
    docs, index = table(spark, d, "documents"), text_index(spark, d)
    status = F.when((F.col("lang") == "en") & (F.col("source") != "src3"), "in_force").when(F.col("lang") == "fr", "superseded").otherwise("repealed")
    chunks = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("municipality_slug"), F.col("source").alias("section_number"), F.col("doc_id").alias("document_id"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("document_title"), status.alias("document_status"))
    asked = index.rarest(table(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id")), 2)
    found = resolve(index, chunks, asked, own_terms=True)
    return found.withColumn("outdated", F.array_join("outdated", "; "))
