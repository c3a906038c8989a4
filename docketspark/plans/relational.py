"""Relational queries over the star schema, which stands in for the document tables: the docstrings say how."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketspark.operators import relational as R
from docketspark.operators.retrieval import with_provenance
from docketspark.plans.registry import query
from docketspark.session import scratch, table
from docketspark.sources.keyed import KeyedTable, delete_cascade


@query("""SELECT n_nationkey, n_name, coalesce(c.n, 0) AS n_documents FROM nation
       LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1) c ON c.c_nationkey = n_nationkey""")
def coverage_counts(spark: SparkSession, d: str) -> DataFrame:
    """Municipalities (nation) with their documents in force (customers with a positive balance)."""
    return R.coverage(table(spark, d, "nation"), table(spark, d, "customer"), "n_nationkey", "c_nationkey", F.col("c_acctbal") > 0, "n_documents").select("n_nationkey", "n_name", "n_documents")


@query("SELECT doc_id, source FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def documents_without_labels(spark, d):
    """Jobs that have no documents: an anti-join."""
    return R.without(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id", "source")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def repealed_semi_join(spark, d):
    """Documents that a repeal names: a semi-join."""
    return R.among(table(spark, d, "documents"), table(spark, d, "labels").filter("toxic = 1"), "doc_id").select("doc_id", "lang")


@query("""SELECT p_partkey, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS n_lines,
       (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R') AS n_returned FROM part""")
def document_subquery_counts(spark, d):
    """Documents (part) with several correlated counts of their chunks (lineitem), from one aggregation."""
    counts = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n_lines"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned"))
    return table(spark, d, "part").select("p_partkey").join(counts, "p_partkey", "left").fillna(0, ["n_lines", "n_returned"])


@query("""SELECT l_orderkey, l_linenumber, o_orderdate, o_orderstatus, c_name, n_name, p.total AS section_total
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0
       LEFT JOIN nation ON c_nationkey = n_nationkey
       LEFT JOIN (SELECT l_orderkey AS k, l_linenumber AS n, round(l_quantity * 2, 2) AS total FROM lineitem WHERE l_returnflag = 'N') p ON p.k = l_orderkey AND p.n = l_linenumber""")
def provenance_join(spark, d):
    """Chunk with document (inner), municipality (left), section (left) and page (left, on a key of two columns)."""
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    pages = lines.filter("l_returnflag = 'N'").select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") * 2, 2).alias("section_total"))
    out = lines.select("l_orderkey", "l_linenumber").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    out = out.join(table(spark, d, "customer").filter("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left")
    out = out.join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left")  # a dimension of fixed size
    return out.join(pages, ["l_orderkey", "l_linenumber"], "left").select("l_orderkey", "l_linenumber", "o_orderdate", "o_orderstatus", "c_name", "n_name", "section_total")


@query("""WITH pg AS (SELECT l_orderkey, l_linenumber, bool_or(l_returnflag = 'R') AS ocr, min(l_discount) AS conf, max(l_quantity) AS w, min(l_tax) AS h FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL)
       SELECT l_orderkey * 10 + l_linenumber AS chunk_id, l_linestatus AS body, l_returnflag AS chunk_type, l_linenumber AS page_number, l_linenumber + 1 AS page_end, o_orderkey AS document_id, o_orderpriority AS document_title, CAST(o_orderkey % 977 AS VARCHAR) AS bylaw_number,
         CASE o_orderstatus WHEN 'F' THEN 'in_force' WHEN 'O' THEN 'unknown' ELSE 'superseded' END AS document_status, CAST(o_orderdate AS DATE) AS consolidation_date, CAST(o_orderdate AS DATE) + 30 AS last_amendment_date, CAST(o_orderdate AS DATE) - 30 AS effective_date,
         'city-' || c_custkey AS municipality_slug, c_name AS municipality_name, p_brand AS section_number, p_brand || ' > ' || p_type AS section_path, p_name AS section_heading, ocr AS from_ocr, round(conf, 2) AS extraction_confidence, w AS page_width, round(h, 2) AS page_height
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey LEFT JOIN (SELECT * FROM part WHERE p_size > 5) ON p_partkey = l_partkey LEFT JOIN pg USING (l_orderkey, l_linenumber)""")
def provenance_projection(spark, d):
    """Lines as chunks with the 21 columns of provenance: orders as documents, customers as cities, parts as sections; some of each are missing."""
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    day = F.to_date("o_orderdate")
    chunks = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_linestatus").alias("body"), F.col("l_returnflag").alias("chunk_type"), F.col("l_linenumber").alias("page_number"), (F.col("l_linenumber") + 1).alias("page_end"), F.col("l_orderkey").alias("document_id"), F.col("l_partkey").alias("section_id"))
    status = F.when(F.col("o_orderstatus") == "F", "in_force").when(F.col("o_orderstatus") == "O", "unknown").otherwise("superseded")
    documents = orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), (F.col("o_orderkey") % 977).cast("string").alias("bylaw_number"), status.alias("status"), day.alias("consolidation_date"),
        F.date_add(day, 30).alias("last_amendment_date"), F.date_sub(day, 30).alias("effective_date"), F.col("o_custkey").alias("municipality_id"),
    )
    cities = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.concat(F.lit("city-"), F.col("c_custkey").cast("string")).alias("canonical_slug"), F.col("c_name").alias("name"))
    sections = table(spark, d, "part").filter("p_size > 5").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("section_number"), F.concat("p_brand", F.lit(" > "), "p_type").alias("full_path"), F.col("p_name").alias("heading"))
    pages = lines.filter("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page_number")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("was_ocred"), F.round(F.min("l_discount"), 2).alias("extraction_confidence"), F.max("l_quantity").alias("width"), F.round(F.min("l_tax"), 2).alias("height"))
    return with_provenance(chunks, documents, cities, sections, pages)


@query("""SELECT doc_id, n_chars FROM documents WHERE lang IN ('en', 'fr') AND source <> 'src3' AND n_chars BETWEEN 200 AND 5000
       AND NOT coalesce(lang = 'fr' AND source = 'src5', false) ORDER BY n_chars DESC, doc_id LIMIT 50""")
def prefilter_topk(spark, d):
    """Slug, status, year-range and OCR filters before ranking, then the top 50 with a unique tie key."""
    kept = table(spark, d, "documents").filter(F.col("lang").isin("en", "fr") & (F.col("source") != "src3") & F.col("n_chars").between(200, 5000) & ~F.coalesce((F.col("lang") == "fr") & (F.col("source") == "src5"), F.lit(False)))
    return R.top_k(kept.select("doc_id", "n_chars"), 50, F.desc("n_chars"), F.asc("doc_id"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_final, coalesce(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'X'), 0.0) AS mean_missing, max(o_orderdate) AS last_date FROM orders")
def global_counts(spark, d):
    """Global and filtered counts, a mean that is 0 where nothing counts, the last amendment date."""
    return table(spark, d, "orders").agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("n_final"), F.coalesce(F.avg(F.when(F.col("o_orderstatus") == "X", F.col("o_totalprice"))), F.lit(0.0)).alias("mean_missing"), F.max("o_orderdate").alias("last_date")
    )


@query("SELECT o_orderstatus AS status, o_orderpriority AS band, count(*) AS n FROM orders GROUP BY 1, 2")
def status_histogram(spark, d):
    """Histogram of statuses."""
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("band")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT l_returnflag AS flag, round(l_discount, 2) AS mode, sum(CAST(l_quantity AS BIGINT)) AS weight, min(l_orderkey * 10 + l_linenumber) AS pos FROM lineitem GROUP BY 1, 2)
       SELECT flag, mode, weight FROM s QUALIFY row_number() OVER (PARTITION BY flag ORDER BY weight DESC, pos) = 1""", weight="BIGINT")
def weighted_mode(spark, d):
    """Modal font size by the text set in it: the value of the greatest summed weight, the first one met on ties."""
    lines = table(spark, d, "lineitem").withColumn("flag", F.col("l_returnflag"))
    return R.weighted_mode(lines, ["flag"], F.round("l_discount", 2), F.col("l_quantity").cast("long"), F.col("l_orderkey") * 10 + F.col("l_linenumber"))


@query("""WITH g AS (SELECT l_partkey, l_returnflag, count(DISTINCT l_suppkey) AS n_sources FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) >= 2),
       f AS (SELECT l_partkey, l_returnflag, l_suppkey, min(l_orderkey * 10 + l_linenumber) AS pos FROM lineitem GROUP BY 1, 2, 3)
       SELECT l_partkey, l_returnflag, any_value(n_sources) AS n_sources, string_agg(CAST(l_suppkey AS VARCHAR), '|' ORDER BY pos, l_suppkey) AS titles
       FROM g JOIN f USING (l_partkey, l_returnflag) GROUP BY 1, 2""")
def conflict_groups(spark, d):
    """Sections that two or more documents in force speak to."""
    lines = table(spark, d, "lineitem").withColumn("at", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return R.conflict_groups(lines, ["l_partkey", "l_returnflag"], "l_suppkey", "l_suppkey", "at")


@query("""SELECT o_custkey, count(DISTINCT (o_orderstatus, o_orderpriority)) AS n_places,
       round((max(o_totalprice) - (sum(o_totalprice) - max(o_totalprice)) / (count(*) - 1)) / abs(max(o_totalprice)), 6) AS margin
       FROM orders GROUP BY 1 HAVING count(*) > 1""")
def corroboration_and_margin(spark, d):
    """Distinct (document, section) pairs and the margin of the best score over the rest."""
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderstatus", "o_orderpriority").alias("n_places"), F.max("o_totalprice").alias("best"), F.sum("o_totalprice").alias("total"), F.count("*").alias("n"))
    return g.filter("n > 1").select("o_custkey", "n_places", F.round(R.margin(F.col("best"), F.col("total"), F.col("n")), 6).alias("margin"))


@query("""WITH v AS (SELECT event_type, list_sort(list(value)) AS vs FROM events WHERE value IS NOT NULL AND value > 0 GROUP BY 1)
       SELECT event_type, len(vs) AS n, vs[least(len(vs), CAST(floor(len(vs) * 0.5) AS BIGINT) + 1)] AS p50, vs[least(len(vs), CAST(floor(len(vs) * 0.95) AS BIGINT) + 1)] AS p95 FROM v""")
def p95_nearest_rank(spark, d):
    """Latency percentiles by nearest rank; errors and zeros do not count."""
    return R.nearest_rank(table(spark, d, "events").filter("value > 0"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("SELECT user_id, event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_state(spark, d):
    """A job's state is its last event."""
    return R.first_per(table(spark, d, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type", "ts")


@query("""WITH now AS (SELECT max(ts) - INTERVAL 7 DAY AS t FROM events),
       c AS (SELECT user_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
       SELECT n_nationkey AS user_id, CASE WHEN c.ts IS NULL THEN 'miss' WHEN c.ts + INTERVAL 5 DAY <= t THEN 'stale' ELSE 'fresh' END AS outcome
       FROM nation CROSS JOIN now LEFT JOIN c ON c.user_id = n_nationkey""", user_id="BIGINT")
def ttl_cache(spark, d):
    """Cached lookups: fresh, stale or missing at a given time. The time is the table's last, not the clock's."""
    events = table(spark, d, "events")
    cached = R.first_per(events.join(F.broadcast(table(spark, d, "nation")), F.col("user_id") == F.col("n_nationkey"), "left_semi"), ["user_id"], F.desc("ts"), F.desc("event_id"))
    as_of = events.agg((F.max("ts") - F.expr("INTERVAL 7 DAYS")).alias("t")).scalar()
    asked = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("user_id"))
    expires = F.col("ts") + F.expr("INTERVAL 5 DAYS")
    return asked.join(cached.select("user_id", "ts"), "user_id", "left").select("user_id", F.when(F.col("ts").isNull(), "miss").when(expires <= as_of, "stale").otherwise("fresh").alias("outcome"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 500")
def newest_documents(spark, d):
    """The newest 500 documents."""
    return R.top_k(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), 500, F.desc("o_orderdate"), F.asc("o_orderkey"))


@query("SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3", rank="INTEGER")
def per_city_topk(spark, d):
    """The top three of each city."""
    return R.top_k_per(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), 3, ["o_custkey"], F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("SELECT p_brand, p_partkey, p_size FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) = 1")
def argmax_first_tie(spark, d):
    """The deepest section of each document, the first on ties."""
    return R.first_per(table(spark, d, "part"), ["p_brand"], F.desc("p_size"), F.asc("p_partkey")).select("p_brand", "p_partkey", "p_size")


@query("""WITH sec AS (SELECT o_custkey AS doc, o_orderkey AS section, CAST(o_orderkey % 50 AS BIGINT) AS page_start, CAST(o_orderkey % 50 + o_orderkey % 9 AS BIGINT) AS page_end, CAST(o_orderkey % 4 AS BIGINT) AS level FROM orders),
       pages AS (SELECT c_custkey AS doc, CAST(c_custkey % 60 AS BIGINT) AS page FROM customer)
       SELECT pages.doc, page, section, page_start, page_end, level FROM pages LEFT JOIN sec ON sec.doc = pages.doc AND page BETWEEN page_start AND page_end
       QUALIFY row_number() OVER (PARTITION BY pages.doc ORDER BY level DESC, section) = 1""")
def range_join_page_section(spark, d):
    """The deepest section whose pages contain a table's page."""
    spans = table(spark, d, "orders").select(
        F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("section"), (F.col("o_orderkey") % 50).alias("page_start"), (F.col("o_orderkey") % 50 + F.col("o_orderkey") % 9).alias("page_end"), (F.col("o_orderkey") % 4).alias("level")
    )
    points = table(spark, d, "customer").select(F.col("c_custkey").alias("doc"), (F.col("c_custkey") % 60).alias("page"))
    return R.interval_join(points, spans, ["doc"], "page", "page_start", "page_end", "level", "section", 16)


@query("""WITH b AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, abs(CAST(embedding[3] AS DOUBLE)) AS w, abs(CAST(embedding[4] AS DOUBLE)) AS h FROM embeddings),
       p AS (SELECT l.vec_id AS line, t.vec_id AS tab, CASE WHEN l.w * l.h > 0 THEN
         greatest(0, least(l.a + l.w, t.a + 2 * t.w) - greatest(l.a, t.a)) * greatest(0, least(l.b + l.h, t.b + 2 * t.h) - greatest(l.b, t.b)) / ((l.a + l.w - l.a) * (l.b + l.h - l.b)) ELSE 0 END AS share
         FROM b l JOIN b t ON l.label = t.label AND l.vec_id <> t.vec_id)
       SELECT line, tab, round(share, 6) AS share FROM p WHERE share >= 0.5""")
def bbox_overlap_join(spark, d):
    """Lines that lie by half or more in a table on their page: every vector is a line, and a table of twice its size."""
    e = F.col("embedding")
    base = table(spark, d, "embeddings").select("vec_id", "label", *[e[i].cast("double").alias(f"e{i}") for i in range(4)])

    def box(grow: int):
        return F.struct(F.col("e0").alias("x0"), F.col("e1").alias("y0"), (F.col("e0") + grow * F.abs("e2")).alias("x1"), (F.col("e1") + grow * F.abs("e3")).alias("y1"))

    lines = base.select(F.col("vec_id").alias("line"), "label", box(1).alias("line_box"))
    tables = base.select(F.col("vec_id").alias("tab"), "label", box(2).alias("tab_box"))
    found = R.box_join(lines, tables, ["label"], "line_box", "tab_box", 0.1).filter("line <> tab")
    return found.select("line", "tab", F.round("share", 6).alias("share"))


@query("""SELECT a.o_orderkey AS amendment, count(*) AS n_absorbing, max(b.o_orderdate) AS last_consolidation
       FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderstatus = 'O' AND b.o_orderdate >= a.o_orderdate
       WHERE a.o_orderstatus = 'P' GROUP BY 1""")
def absorbed_amendments(spark, d):
    """Amendments (P) that a later consolidation (O) of the same bylaw absorbs: an equi-join with an inequality."""
    orders = table(spark, d, "orders")
    a = orders.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("amendment"), "o_custkey", F.col("o_orderdate").alias("own"))
    b = orders.filter("o_orderstatus = 'O'").select("o_custkey", "o_orderdate")
    return a.join(b, "o_custkey").filter("o_orderdate >= own").groupBy("amendment").agg(F.count("*").alias("n_absorbing"), F.max("o_orderdate").alias("last_consolidation"))


@query("""WITH z AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS ids, list(o_orderstatus ORDER BY o_orderkey) FILTER (WHERE o_orderstatus <> 'P') AS st FROM orders GROUP BY 1)
       SELECT o_custkey, CAST(i AS INTEGER) AS pos, ids[i + 1] AS id, st[i + 1] AS status FROM (SELECT *, unnest(range(0, least(len(ids), coalesce(len(st), 0)))) AS i FROM z)""")
def positional_zip(spark, d):
    """Ids and values zipped by position, the longer list cut: ranked rows joined on their position."""
    orders = table(spark, d, "orders")
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    left = orders.select("o_custkey", (F.row_number().over(w) - 1).alias("pos"), F.col("o_orderkey").alias("id"))
    right = orders.filter("o_orderstatus <> 'P'").select("o_custkey", (F.row_number().over(w) - 1).alias("pos"), F.col("o_orderstatus").alias("status"))
    return left.join(right, ["o_custkey", "pos"]).select("o_custkey", "pos", "id", "status")


@query("""SELECT c_custkey AS key, 'amends' AS kind FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'repeals' FROM customer WHERE c_mktsegment = 'BUILDING'""")
def union_edges(spark, d):
    """Two sets of edges in one."""
    c = table(spark, d, "customer")
    return c.filter("c_acctbal < 0").select(F.col("c_custkey").alias("key"), F.lit("amends").alias("kind")).unionByName(c.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("key"), F.lit("repeals").alias("kind")))


@query("SELECT DISTINCT l_suppkey AS s FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0")
def acceptable_retrieved(spark, d):
    """Acceptable sections among those retrieved."""
    return table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("s")).intersect(table(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("s")))


@query("""WITH u AS (SELECT s_suppkey, CAST(s_acctbal AS DOUBLE) AS s_acctbal FROM supplier),
       c AS (SELECT l_suppkey AS s_suppkey, l_extendedprice AS s_acctbal FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) = 1)
       SELECT * FROM c UNION ALL SELECT * FROM u WHERE s_suppkey NOT IN (SELECT s_suppkey FROM c)""")
def upsert_latest(spark, d):
    """Vectors and cached lookups written on conflict: the last change of a key wins."""
    changes = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_extendedprice").alias("s_acctbal"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("at"))
    target = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").cast("double").alias("s_acctbal"))
    return R.upsert(target, changes, ["s_suppkey"], F.col("at"))


@query("""SELECT r_regionkey AS k, r_name AS name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey FROM region)""")
def insert_ignore(spark, d):
    """Rows added unless their key is there."""
    target = table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    return R.insert_ignore(target, table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), ["k"])


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_mktsegment ELSE coalesce(n.v, c_mktsegment) END AS c_mktsegment FROM customer
       LEFT JOIN (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END) AS v FROM orders GROUP BY 1) n ON n.o_custkey = c_custkey""")
def guarded_update(spark, d):
    """Statuses updated unless a person verified them; null keeps what is there."""
    changes = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("c_mktsegment"))
    target = table(spark, d, "customer").select("c_custkey", "c_mktsegment", (F.col("c_acctbal") < 0).alias("verified"))
    return R.guarded_update(target, changes, ["c_custkey"], ["c_mktsegment"], "verified").drop("verified")


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey = 3 THEN 'active' WHEN n_nationkey % 5 = 0 THEN 'retired' ELSE 'building' END AS status FROM nation")
def activate_swap(spark, d):
    """One collection becomes active, the ones that were are retired."""
    given = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 5 == 0, "active").otherwise("building").alias("status"))
    return R.activate(given, F.col("id") == 3)


@query("""SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN NOT l_quantity <= 45 THEN 'quantity' END, CASE WHEN NOT l_discount < 0.1 THEN 'discount' END, CASE WHEN NOT l_orderkey <> l_partkey THEN 'self' END], lambda x: x IS NOT NULL), ',') AS broken
       FROM lineitem WHERE NOT (l_quantity <= 45 AND l_discount < 0.1 AND l_orderkey <> l_partkey)""")
def constraint_quarantine(spark, d):
    """Rows that break a check, with the names of those broken."""
    checks = {"quantity": F.col("l_quantity") <= 45, "discount": F.col("l_discount") < 0.1, "self": F.col("l_orderkey") != F.col("l_partkey")}
    return R.quarantine(table(spark, d, "lineitem"), checks)[1].select("l_orderkey", "l_linenumber", F.array_join("broken", ",").alias("broken"))


@query("""SELECT conv_id, turn, CAST(coalesce(sum(length(coalesce(text, '')) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start,
       row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn,
       count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS heading FROM conversations""", ordinal="INTEGER")
def running_offsets(spark, d):
    """Character offsets over lines, ordinals, the next heading and the heading a line belongs to."""
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").withColumn("size", F.length(F.coalesce("text", F.lit(""))))
    return R.ancestors_offset(rows, ["conv_id"], ["turn"], "size").select(
        "conv_id", "turn", "char_start", (F.row_number().over(w) - 1).alias("ordinal"), F.lead("turn").over(w).alias("next_turn"), F.count_if(F.col("role") == "user").over(w).alias("heading")
    )


@query("""SELECT p_type AS sign_type, dimension, CASE WHEN p_brand = 'Brand#11' AND dimension = 'height' THEN 'override' ELSE 'default' END AS origin, count(*) AS n
       FROM part CROSS JOIN (VALUES ('area'), ('height'), ('setback')) v(dimension) WHERE p_size > 10 GROUP BY 1, 2, 3""")
def dimension_fanout(spark, d):
    """Specs by dimension: a fixed list of dimensions over all specs, with an override of the rules' defaults."""
    parts = table(spark, d, "part").filter("p_size > 10").select(F.col("p_type").alias("sign_type"), "p_brand", F.explode(F.array(*map(F.lit, ("area", "height", "setback")))).alias("dimension"))
    origin = F.when((F.col("p_brand") == "Brand#11") & (F.col("dimension") == "height"), "override").otherwise("default")
    return parts.groupBy("sign_type", "dimension", origin.alias("origin")).agg(F.count("*").alias("n"))


@query("""SELECT n_regionkey AS region, bool_or(c_acctbal < -900) AS any_failing, bool_and(c_acctbal > -1000) AS all_required,
       CASE max(CASE WHEN c_acctbal < -900 THEN 2 WHEN c_acctbal < 0 THEN 1 ELSE 0 END) WHEN 2 THEN 'exceeds' WHEN 1 THEN 'indeterminate' ELSE 'complies' END AS verdict
       FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def severity_rollup(spark, d):
    """Severity lattice and health roll-up: any, all, and the gravest verdict."""
    rows = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    code = F.max(F.when(F.col("c_acctbal") < -900, 2).when(F.col("c_acctbal") < 0, 1).otherwise(0))
    return rows.groupBy(F.col("n_regionkey").alias("region")).agg(
        F.bool_or(F.col("c_acctbal") < -900).alias("any_failing"), F.bool_and(F.col("c_acctbal") > -1000).alias("all_required"), F.when(code == 2, "exceeds").when(code == 1, "indeterminate").otherwise("complies").alias("verdict")
    )


@query("""WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN 'changed' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 50 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer
         UNION ALL SELECT c_custkey + 10000000, 'new', c_acctbal FROM customer WHERE c_custkey % 70 = 0)
       SELECT c_custkey, c_mktsegment, round(c_acctbal, 2) AS c_acctbal, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM t WHERE c_mktsegment <> 'MACHINERY' OR c_custkey % 3 <> 0""")
def keyed_writes(spark, d):
    """Customers and their orders as tables with keyed writes: some rows change, some are new, some go with their orders."""
    customers = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    parent = KeyedTable(spark, scratch(spark, "keyed-customers"), ["c_custkey"], 16)
    child = KeyedTable(spark, scratch(spark, "keyed-orders"), ["c_custkey"], 16)
    parent.create(customers)
    child.create(orders)
    changed = customers.filter("c_custkey % 50 = 0").select("c_custkey", F.lit("changed").alias("c_mktsegment"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    stale = changed.select("c_custkey", F.lit("stale").alias("c_mktsegment"), "c_acctbal")
    new = customers.filter("c_custkey % 70 = 0").select((F.col("c_custkey") + 10_000_000).alias("c_custkey"), F.lit("new").alias("c_mktsegment"), "c_acctbal")
    parent.upsert(changed.unionByName(stale), F.when(F.col("c_mktsegment") == "stale", 0).otherwise(1))
    parent.insert_ignore(new.unionByName(stale))
    delete_cascade(parent.read().filter("c_mktsegment = 'MACHINERY' and c_custkey % 3 = 0").select("c_custkey"), parent, [child])
    counts = child.read().groupBy("c_custkey").agg(F.count("*").alias("n_orders"))
    left = parent.read().join(counts, "c_custkey", "left")
    return left.select("c_custkey", "c_mktsegment", F.round("c_acctbal", 2).alias("c_acctbal"), F.coalesce("n_orders", F.expr("0L")).alias("n_orders"))
