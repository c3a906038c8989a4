"""Documents' life over the star schema."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketspark.functions import plugins, states
from docketspark.functions import text as T
from docketspark.operators import documents as D
from docketspark.operators import retrieval as V
from docketspark.operators import tables as TB
from docketspark.plans.registry import query
from docketspark.plans.text import each, each_sql, every, every_sql
from docketspark.session import table

_STATES = [("indexed", None, "ready", True), ("ocr", None, "processing", False), ("chunked", "boom #", "failed", True), ("nonsense", None, "pending", False), ("sections", "", "processing", True)]


@query(f"SELECT key, state, sectioned FROM {each_sql('state, sectioned', *[x[2:] for x in _STATES])}")
def document_states(spark, d):
    """States of customers' documents and whether they came as far as sections."""
    given = each(spark, d, "stage string, error string", *[x[:2] for x in _STATES])
    return given.select("key", states.document_state(F.col("stage"), F.col("error")).alias("state"), states.is_at_least(F.col("stage"), F.lit("sections")).alias("sectioned"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus ORDER BY l_linenumber) = 1""")
def distinct_citations(spark, d):
    """An order's lines as citations: of those with one flag and status the first stays; of lines of one number, the one that stands first in the table."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", F.col("l_returnflag").alias("chunk_id"), F.col("l_linestatus").alias("quote"), *place)
    return D.distinct_citations(lines, "l_orderkey", "l_linenumber", "file", "row").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")


@query("""SELECT vec_id, round(e1 / 2.0, 6) AS x0, round(e1 / 4.0, 6) AS y0, round(e2 / 2.0, 6) AS x1, round(e2 / 4.0, 6) AS y1 FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS e1, CAST(embedding[2] AS DOUBLE) AS e2 FROM embeddings)""")
def box_ratios(spark, d):
    """Boxes as shares of their page."""
    e = F.col("embedding")
    box = F.struct(e[0].cast("double").alias("x0"), e[0].cast("double").alias("y0"), e[1].cast("double").alias("x1"), e[1].cast("double").alias("y1"))
    r = states.as_ratios(box, F.lit(2.0), F.lit(4.0))
    return table(spark, d, "embeddings").select("vec_id", *[F.round(r[c], 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("SELECT coalesce(max(p_size) FILTER (WHERE p_brand = 'Brand#11' AND p_type LIKE 'E%'), 0) + 1 AS index_version FROM part")
def next_index_version(spark, d):
    """The next version of an index; parts stand for collections."""
    made = table(spark, d, "part").select(F.col("p_brand").alias("model"), F.col("p_type").startswith("E").cast("int").alias("chunking_version"), F.col("p_size").alias("index_version"))
    return D.next_version(made, "Brand#11", 1)


@query("SELECT sha256(text) AS content_hash, count(*) AS n FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en' AND text IS NOT NULL) GROUP BY 1")
def contents_to_embed(spark, d):
    """Contents without a vector, each once, with the number of documents that will share it."""
    docs = table(spark, d, "documents").withColumnRenamed("text", "body")
    known = docs.filter("lang = 'en' AND body IS NOT NULL").select(F.sha2("body", 256).alias("content_hash"), F.lit("m").alias("model"))
    new = D.to_embed(docs.select("body"), known, "m").select("content_hash")
    return docs.select(F.sha2("body", 256).alias("content_hash")).groupBy("content_hash").agg(F.count("*").alias("n")).join(new, "content_hash")


_META_A = [("surrey #", None, "1,#"), (None, "T #", ""), (None, None, None)]
_META_B = [("delta", "B #", "#,3"), (None, None, None), ("hope #", "H", "9")]


@query(f"SELECT key, slug, title, amends FROM {each_sql('slug, title, amends', ('surrey #', 'B #', '1,#,3'), (None, 'T #', ''), ('hope #', 'H', '9'))}")
def merged_metadata(spark, d):
    """Metadata of customers' documents from two sources, the first one's fields before the second's; each source lacks some rows."""

    def source(position, *written):
        given = each(spark, d, "slug string, title string, amends string", *written).filter(F.col("key") % 3 != position)
        return given.withColumn("amends", F.filter(F.split(F.coalesce("amends", F.lit("")), ","), lambda x: x != ""))

    return D.merge_metadata(source(2, *_META_A), source(1, *_META_B), "key", ("amends",)).select("key", "slug", "title", F.array_join("amends", ",").alias("amends"))


@query()
def embed_documents(spark, d):
    """Vectors of whole texts by the offline embedder; their length and repetition are tested."""
    vectors = table(spark, d, "documents").select("doc_id", plugins.embed(F.col("text"), plugins.hashing_embedder, "passage: ").alias("v"))
    return vectors.select("doc_id", F.size("v").alias("dims"), F.round(V.dot(F.col("v"), F.col("v")), 3).alias("norm"))


_ASKED = [(1, "How high may a pylon sign be?"), (2, "Is a permit required?"), (3, "Anything?")]
_FOUND = [(1, 1, 11, "A pylon sign must not exceed #.5 m. More follows.", "Bylaw A", "5.3", 4), (1, 2, 12, "Other text.", "Bylaw A", "5.4", 5), (2, 1, 13, "A permit is required for all # signs.", "Bylaw B", None, 1)]


@query(f"SELECT key * 10 + question AS question_id, answer, n_valid, abstain, outcome FROM {every_sql('question, answer, n_valid, abstain, outcome', (1, 'A pylon sign must not exceed #.5 m. [S1]', 1, False, 'answered'), (2, 'A permit is required for all # signs. [S1]', 1, False, 'answered'), (3, '', 0, False, 'no_relevant'))}", question_id="BIGINT")
def answer_questions(spark, d):
    """Suppliers' questions answered end to end with the extractive default."""
    number = F.col("key") * 10 + F.col("question_id")
    questions = every(spark, d, "question_id int, question string", *_ASKED).withColumn("question_id", number).drop("key")
    found = every(spark, d, "question_id int, rank int, chunk_id int, body string, document_title string, section_number string, page_number int", *_FOUND)
    found = found.withColumn("question_id", number).withColumn("chunk_id", F.col("key") * 100 + F.col("chunk_id")).drop("key")
    return D.answer(questions, found).select("question_id", "answer", F.col("n_valid").cast("int").alias("n_valid"), "abstain", "outcome")


def order_pages(spark, d):
    """Orders as pages: a heading, a grid with a part, a quantity and mostly a price in each row, set unevenly, and a last line."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")  # line numbers repeat
    lines = table(spark, d, "lineitem").withColumn("k", F.row_number().over(order))
    page = [F.col("l_orderkey").alias("document_id"), F.lit(1).alias("page_number")]

    def line(no, text, x0, y0, x1, y1):
        box = F.struct(*[F.lit(v).cast("double").alias(n) if not hasattr(v, "cast") else v.cast("double").alias(n) for n, v in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))])
        return F.struct(F.lit(no).cast("long").alias("line_no") if not hasattr(no, "cast") else no.cast("long").alias("line_no"), text.alias("text"), box.alias("box"))

    k, shift = F.col("k"), F.col("l_partkey") % 5
    top = 20 + 20 * k + shift
    cells = [line(10 * k + 1, F.concat(F.lit(" p"), F.col("l_partkey").cast("string")), 5 + shift, top, 60, top + 12), line(10 * k + 2, F.col("l_quantity").cast("long").cast("string"), 100, top + 1, 140 - shift, top + 9)]
    price = line(10 * k + 3, F.concat(F.lit("$"), F.col("l_suppkey").cast("string"), F.lit("|x")), 200 + shift, top, 260, top + 11)
    fixed = [line(0, F.lit("An order of lines"), 0, 0, 300, 12), line(1, F.lit("Part"), 0, 20, 40, 30), line(2, F.lit("Qty"), 100, 20, 130, 30), line(3, F.lit("Price  each"), 205, 20, 250, 30), line(9999, F.lit("End"), 0, 5000, 300, 5010)]
    # a line's boxes, and with an order's first line those of the page, are made in one pass over the lines
    none = F.array().cast("array<struct<line_no: bigint, text: string, box: struct<x0: double, y0: double, x1: double, y1: double>>>")
    drawn = F.concat(F.array(*cells), F.when(F.col("l_tax") > 0, F.array(price)).otherwise(none), F.when(k == 1, F.array(*fixed)).otherwise(none))
    return lines.select(*page, F.inline(drawn))


@query("""SELECT l_orderkey AS document_id, 0 AS ordinal, count(*) + 1 AS n_rows, 'Part,Qty,Price each' AS headers, 2 AS n_prose,
       '| Part | Qty | Price each |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| p' || l_partkey || ' | ' || CAST(l_quantity AS BIGINT) || ' | ' || CASE WHEN l_tax > 0 THEN '$' || l_suppkey || '\\|x' ELSE '' END || ' |', chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS markdown
       FROM lineitem GROUP BY 1""", ordinal="INTEGER", n_rows="INTEGER")
def lifted_tables(spark, d):
    """The table of every order's page, lifted from its lines' boxes, and the number of lines that are left as prose."""
    found = TB.lift_tables(order_pages(spark, d))
    return found.select("document_id", "ordinal", F.size("rows").alias("n_rows"), F.array_join("headers", ",").alias("headers"), F.col("n_prose").cast("int").alias("n_prose"), "markdown")


@query(r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source, lang, coalesce(n_chars, 0) // 3000 + 1 AS page FROM documents)
       SELECT doc_id, CASE WHEN length(text) <= 320 THEN text WHEN contains(substr(text, 1, 320), '. ') THEN regexp_extract(substr(text, 1, 320), '(?s)^(.*\.) ', 1) ELSE substr(text, 1, 320) END AS opening,
         CASE WHEN length(text) <= 60 THEN text ELSE substr(text, 1, 59) || '…' END AS short, concat_ws(', ', 'Bylaw No. ' || source, 's. ' || lang, 'p. ' || page) AS label, 'documents/' || doc_id || '#page=' || page AS link FROM d""")
def citation_texts(spark, d):
    """What a citation of every document shows: its opening sentences, a short form, a label and a link to its last page."""
    docs = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("page", (F.floor(F.coalesce("n_chars", F.lit(0)) / 3000) + 1).cast("int"))
    text = F.col("text")
    return docs.select("doc_id", T.first_sentences(text).alias("opening"), T.truncate(text, 60).alias("short"), T.citation_label(F.col("source"), F.col("lang"), F.col("page")).alias("label"), states.deep_link(F.col("doc_id"), F.col("page")).alias("link"))


@query("""SELECT p_partkey, trim(regexp_replace(lower(p_name || '.' || p_type), '[^a-z0-9]+', '-', 'g'), '-') AS model, trim(regexp_replace(lower(p_name || '.' || p_type), '[^a-z0-9]+', '-', 'g'), '-') || '__c' || p_size || '__v' || p_partkey % 9 AS collection, p_size || '.' || p_partkey % 9 AS section FROM part""")
def collection_names(spark, d):
    """Parts as models: the names of models and of their collections, and section numbers as an evaluation compares them."""
    parts = table(spark, d, "part")
    model, version, size = F.concat(F.lit("org/"), "p_name", F.lit("."), "p_type"), F.col("p_partkey") % 9, F.col("p_size")
    written = F.concat(F.element_at(F.array(*map(F.lit, ("Section ", " sec. ", "s. ", ""))), (F.col("p_partkey") % 4 + 1).cast("int")), size.cast("string"), F.lit("."), version.cast("string"), F.lit(". "))
    return parts.select("p_partkey", T.model_slug(model).alias("model"), states.collection_name(model, size, version).alias("collection"), T.eval_section(written).alias("section"))


@query("""SELECT o_custkey AS parent, o_orderkey AS child, o_orderpriority AS relation_type, CASE WHEN o_orderkey % 5 = 0 THEN 'human' ELSE 'rule' END AS detected_by, CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'processing' ELSE 'failed' END AS state FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 2 = 0""")
def rebuilt_edges(spark, d):
    """Orders as edges of lineage that are detected anew: those that a person entered stay, others that are not found again go."""
    orders = table(spark, d, "orders")
    by = F.when(F.col("o_orderkey") % 5 == 0, "human").otherwise("rule")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    existing = orders.select(F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("child"), F.col("o_orderpriority").alias("relation_type"), by.alias("detected_by"), states.job_state(status).alias("state"))
    return D.rebuild_edges(existing, existing.filter("child % 2 = 0").withColumn("detected_by", F.lit("rule")))
