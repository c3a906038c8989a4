"""Lineage, confidence, outcomes and evaluation over the star schema; the docstrings name the mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketspark.operators import answers as A
from docketspark.operators import evaluation as E
from docketspark.operators import health as H
from docketspark.operators import lineage as LN
from docketspark.operators import relational as R
from docketspark.plans.registry import query
from docketspark.plans.text import each, each_sql
from docketspark.session import table


def order_facts(spark, d):
    """Orders as document versions: the customer is the city, the priority the bylaw, the status the kind."""
    o = table(spark, d, "orders")
    none = F.array().cast("array<string>")
    kind = F.when(F.col("o_orderstatus") == "F", "consolidated").when(F.col("o_orderstatus") == "P", "amendment").otherwise("base")
    day = F.to_date("o_orderdate")
    other = F.concat(((F.substring("o_orderpriority", 1, 1).cast("int") % 5) + 1).cast("string"), F.lit("-NONE"))
    return o.select(
        F.col("o_orderkey").alias("document_id"),
        F.when(F.col("o_orderkey") % 97 != 0, F.concat(F.lit("city-"), F.col("o_custkey").cast("string"))).alias("municipality_slug"),
        F.concat(F.lit("0"), F.col("o_orderpriority")).alias("bylaw_number"),
        kind.alias("doc_type"),
        F.when(kind == "consolidated", day).alias("consolidation_date"),
        F.when((kind != "consolidated") & (F.col("o_orderkey") % 11 != 0), day).alias("effective_date"),
        F.when(F.col("o_orderkey") % 33 == 0, F.year(day)).alias("year"),
        F.when(kind == "amendment", F.array(other)).otherwise(none).alias("amends"),
        F.when(F.col("o_orderkey") % 29 == 0, F.array(other)).otherwise(none).alias("repeals"),
    )


_FACTS = """f AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 97 <> 0 THEN 'city-' || o_custkey END AS slug, nullif(ltrim(split_part('0' || o_orderpriority, '-', 1), '0'), '') AS key,
         CASE o_orderstatus WHEN 'F' THEN 'consolidated' WHEN 'P' THEN 'amendment' ELSE 'base' END AS kind,
         CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END AS cons,
         coalesce(CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END, CASE WHEN o_orderstatus <> 'F' AND o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) END, CASE WHEN o_orderkey % 33 = 0 THEN make_date(year(o_orderdate), 1, 1) END) AS vd,
         CAST(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) % 5 + 1 AS VARCHAR) AS other, o_orderstatus = 'P' AS amends, o_orderkey % 29 = 0 AS repeals FROM orders),
       k AS (SELECT *, row_number() OVER (PARTITION BY slug, key ORDER BY vd IS NOT NULL DESC, vd DESC NULLS LAST, kind = 'consolidated' DESC, id DESC) AS newness, count(*) OVER (PARTITION BY slug, key) AS versions FROM f WHERE slug IS NOT NULL AND key IS NOT NULL),
       r AS (SELECT t.id AS parent, c.id AS child, 'amends' AS kind, count(*) OVER (PARTITION BY c.id) AS n FROM f c JOIN k t ON c.slug = t.slug AND c.other = t.key AND c.id <> t.id WHERE c.amends
             UNION ALL SELECT t.id, c.id, 'repeals', count(*) OVER (PARTITION BY c.id) FROM f c JOIN k t ON c.slug = t.slug AND c.other = t.key AND c.id <> t.id WHERE c.repeals)"""


@query(f"""WITH {_FACTS} SELECT parent, child, kind AS relation_type, CASE WHEN n = 1 THEN 0.85 ELSE 0.4 END AS confidence FROM r
       UNION ALL SELECT a.id, b.id, CASE WHEN b.kind = 'consolidated' THEN 'consolidates' ELSE 'replaces' END, 0.75 FROM k a JOIN k b ON a.slug = b.slug AND a.key = b.key AND b.newness = 1 AND a.newness > 1""", confidence="DOUBLE")
def lineage_edges(spark, d):
    """Who amends, repeals, consolidates and replaces whom."""
    return LN.edges(order_facts(spark, d))


@query(f"""WITH {_FACTS}, ab AS (SELECT DISTINCT child AS id FROM r JOIN f c ON c.id = child JOIN f p ON p.id = parent WHERE r.kind = 'amends' AND p.kind = 'consolidated' AND p.cons >= c.vd),
       la AS (SELECT parent AS id, max(vd) AS last FROM r JOIN f ON f.id = child WHERE r.kind = 'amends' GROUP BY 1)
       SELECT f.id AS document_id, CASE WHEN f.id IN (SELECT parent FROM r WHERE kind = 'repeals') THEN 'repealed' WHEN f.slug IS NULL OR f.key IS NULL THEN 'unknown' WHEN k.newness > 1 THEN 'superseded'
         WHEN f.vd IS NULL THEN 'unknown' WHEN f.kind = 'amendment' AND f.id IN (SELECT id FROM ab) THEN 'superseded' ELSE 'in_force' END AS status, la.last AS last_amendment_date
       FROM f LEFT JOIN k ON k.id = f.id LEFT JOIN la ON la.id = f.id""")
def version_lineage(spark, d):
    """Status of every version: repealed, superseded, in force or unknown."""
    return LN.resolve(order_facts(spark, d)).drop("needs_review")


@query("""WITH c AS (SELECT o_custkey AS a, o_orderkey AS doc, o_orderpriority AS sec, CASE o_orderstatus WHEN 'F' THEN 'in_force' WHEN 'O' THEN 'unknown' ELSE 'superseded' END AS st, o_totalprice / 1000 AS s, o_orderkey % 5 = 0 AS ocr, (o_orderkey % 101) / 101 AS ec, o_orderkey % 3 = 0 AS cited, o_orderkey % 8 <> 0 AS city FROM orders),
       g AS (SELECT a, bool_or(cited) AS has, count(*) AS n, count(*) FILTER (WHERE cited) AS nc, max(s) AS best, sum(s) AS tot,
         count(*) FILTER (WHERE st = 'in_force' AND cited) AS fc, count(*) FILTER (WHERE st = 'in_force') AS fa, count(*) FILTER (WHERE st = 'unknown' AND cited) AS uc, count(*) FILTER (WHERE st = 'unknown') AS ua,
         count(DISTINCT (doc, sec)) FILTER (WHERE cited) AS pl, avg(ec) FILTER (WHERE cited) AS ecc, avg(ec) AS eca, count(*) FILTER (WHERE ocr AND cited) AS oc, count(*) FILTER (WHERE ocr) AS oa, bool_or(city) AS anycity, coalesce(bool_or(cited AND st <> 'in_force'), false) AS stale FROM c GROUP BY 1),
       h AS (SELECT *, CASE WHEN has THEN nc ELSE n END AS w, a % 10 = 0 AS conflict, a % 13 = 0 AS abst, (a % 4) AS unc, (a % 11) / 10.0 AS prec FROM g),
       i AS (SELECT *, CASE WHEN nc = 0 THEN 0.0 ELSE prec * CASE WHEN unc > 0 THEN greatest(0.3, 1 - 0.25 * unc) ELSE 1 END END AS f1, least(1.0, (CASE WHEN has THEN fc ELSE fa END) / w + 0.4 * (CASE WHEN has THEN uc ELSE ua END) / w) AS f2,
         CASE WHEN conflict THEN 0.25 WHEN pl = 0 THEN 0.2 WHEN pl = 1 THEN 0.6 WHEN pl = 2 THEN 0.85 ELSE 1.0 END AS f3, CASE WHEN n < 2 THEN 0.5 WHEN best <= 0 THEN 0.2 ELSE least(1.0, 3 * greatest(0, (best - (tot - best) / (n - 1)) / abs(best))) END AS f4,
         greatest(0.0, (CASE WHEN has THEN ecc ELSE eca END) - 0.35 * (CASE WHEN has THEN oc ELSE oa END) / w) AS f5, 0.5 * CAST(anycity AS INTEGER) + 0.5 * CAST(has AS INTEGER) AS f6 FROM h),
       j AS (SELECT *, CASE WHEN abst THEN 0 ELSE 3 * CAST(round(1000 * round_even(f1, 3)) AS INTEGER) + 2 * CAST(round(1000 * round_even(f2, 3)) AS INTEGER) + 2 * CAST(round(1000 * CAST(f3 AS DOUBLE)) AS INTEGER)
         + CAST(round(1000 * round_even(f4, 3)) AS INTEGER) + CAST(round(1000 * round_even(f5, 3)) AS INTEGER) + CAST(round(1000 * CAST(f6 AS DOUBLE)) AS INTEGER) END AS t FROM i),
       k AS (SELECT a, stale, t / 1e4 AS raw, round_even(least(10000, greatest(0, t)) / 1e1, 0) / 1e3 AS score FROM j)
       SELECT a AS answer_id, raw, score, CASE WHEN NOT stale AND score >= 0.75 THEN 'high' WHEN NOT stale AND score >= 0.5 THEN 'medium' WHEN score >= 0.25 THEN 'low' ELSE 'insufficient' END AS band, stale FROM k""", raw="DOUBLE", score="DOUBLE")
def confidence_score(spark, d):
    """Confidence of answers made of a customer's orders: the sum, the score and the band."""
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    chunks = o.select(
        F.col("o_custkey").alias("answer_id"), key.alias("document_id"), F.col("o_orderpriority").alias("section_number"), F.when(key % 8 != 0, "city").alias("municipality_slug"),
        F.when(F.col("o_orderstatus") == "F", "in_force").when(F.col("o_orderstatus") == "O", "unknown").otherwise("superseded").alias("status"), (F.col("o_totalprice") / 1000).alias("final_score"),
        (key % 5 == 0).alias("from_ocr"), ((key % 101) / 101).alias("extraction_confidence"), (key % 3 == 0).alias("cited"),
    )
    a = F.col("answer_id")
    answers = chunks.groupBy("answer_id").agg(F.count_if("cited").alias("n_cited"), F.bool_or(F.col("cited") & (F.col("status") != "in_force")).alias("stale")).select(
        "answer_id", "n_cited", (a % 4).alias("n_uncited"), ((a % 11) / 10).alias("precision"), (a % 13 == 0).alias("abstained"), (a % 10 == 0).alias("conflict"), "stale"
    )
    found = A.confidence(chunks, answers).join(answers.select("answer_id", "stale"), "answer_id")
    return found.select("answer_id", "raw", "score", "band", "stale")


_RUNS = [
    (True, False, True, False, 3, 0, False, True, False, "out_of_scope"),
    (False, True, True, False, 3, 0, False, True, False, "needs_clarification"),
    (False, False, False, False, 3, 0, False, True, False, "index_not_ready"),
    (False, False, True, True, 3, 0, False, True, False, "no_relevant"),
    (False, False, True, False, 0, 2, False, True, False, "only_outdated"),
    (False, False, True, False, 0, 0, False, True, False, "no_relevant"),
    (False, False, True, False, 3, 0, True, True, False, "conflicting_amendments"),
    (False, False, True, False, 3, 0, False, False, False, "generation_unavailable"),
    (False, False, True, False, 3, 0, False, True, True, "unverified"),
    (False, False, True, False, 3, 0, False, True, False, "answered"),
]


@query(f"SELECT key, outcome FROM {each_sql('outcome', *[r[-1:] for r in _RUNS])}")
def answer_outcomes(spark, d):
    """Outcomes of customers' runs, in the order of the rules."""
    schema = "out_of_scope boolean, ambiguous boolean, index_ready boolean, retrieval_failed boolean, n_chunks int, n_outdated int, conflict boolean, generated boolean, abstained boolean"
    return each(spark, d, schema, *[r[:-1] for r in _RUNS]).select("key", A.outcome().alias("outcome"))


def scored_cases(spark, d):
    """Labels and documents as golden cases: quality is the expected text, toxicity forbidden text."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    i = F.col("doc_id")
    cases = docs.select(
        "doc_id", F.when(i % 9 == 0, "ambiguity").otherwise("fact").alias("kind"), F.when(i % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("s"), (i % 5).cast("string")))).alias("acceptable"),
        F.array(*[F.concat(F.lit("s"), ((i + k) % 7).cast("string")) for k in range(3)]).alias("retrieved"), ((i % 11) / 10).alias("precision"), (i % 17 == 0).cast("int").alias("n_stale"), F.when(i % 23 == 0, "boom").alias("error"),
        (i % 13 != 0).alias("behaved"), (F.col("quality") == 1).alias("has_expected"), (F.col("toxic") == 1).alias("has_forbidden"), ((i % 10) / 10).alias("confidence"), F.when(i % 6 != 0, F.element_at(F.array(*map(F.lit, ("high", "medium", "low"))), (i % 3 + 1).cast("int"))).alias("band"), "lang",
    )
    return E.score_cases(cases)


_CASES = """c AS (SELECT d.doc_id AS i, lang, quality, toxic, i % 4 = 0 AS anyok, list_position([(i + 0) % 7, (i + 1) % 7, (i + 2) % 7], i % 5) AS pos FROM (SELECT doc_id, lang, doc_id AS i FROM documents) d JOIN labels USING (doc_id)),
       s AS (SELECT *, anyok OR coalesce(pos, 0) > 0 AS rok, CASE WHEN i % 23 = 0 OR i % 17 = 0 OR i % 13 = 0 OR toxic = 1 THEN false WHEN i % 9 = 0 THEN true ELSE (anyok OR coalesce(pos, 0) > 0) AND (i % 11) / 10 >= 0.5 AND quality = 1 END AS passed,
         CASE WHEN i % 6 = 0 THEN 'unknown' ELSE ['high', 'medium', 'low'][i % 3 + 1] END AS band FROM c)"""


@query(f"""WITH {_CASES} SELECT lang, count(*) AS n, round(avg(CAST(passed AS INTEGER)), 6) AS pass_rate, round(avg(CAST(rok AS INTEGER)), 6) AS retrieval_accuracy, round(avg(CAST(i % 13 <> 0 AS INTEGER)), 6) AS behaviour_accuracy, round(avg((i % 11) / 10), 6) AS citation_accuracy,
       CAST(count(*) FILTER (WHERE i % 17 = 0) AS BIGINT) AS stale, round(avg((i % 10) / 10), 6) AS mean_confidence, count(*) FILTER (WHERE i % 23 = 0) AS errors FROM s GROUP BY lang""")
def eval_suite_report(spark, d):
    """Suite measures by language."""
    r = E.suite_report(scored_cases(spark, d), ["lang"])
    return r.select("lang", "n", *[F.round(c, 6).alias(c) for c in ("pass_rate", "retrieval_accuracy", "behaviour_accuracy", "citation_accuracy")], "stale", F.round("mean_confidence", 6).alias("mean_confidence"), "errors")


@query(f"WITH {_CASES} SELECT band, count(*) AS n, round(avg(CAST(passed AS INTEGER)), 6) AS pass_rate FROM s GROUP BY 1")
def calibration(spark, d):
    """Pass rate of each confidence band."""
    return E.calibration(scored_cases(spark, d)).select("band", "n", F.round("pass_rate", 6).alias("pass_rate"))


def validation_runs(spark, d):
    """Events as validation runs: the value is the latency, the kind the outcome."""
    e, i = table(spark, d, "events"), F.col("event_id")
    return e.select(
        F.when(F.col("event_type") == "purchase", "answered").when(F.col("event_type") == "error", "unverified").otherwise("no_relevant").alias("outcome"), F.floor(F.col("value") * 10).alias("retrieval_ms"), F.floor(F.col("value") * 100).alias("total_ms"), (i % 4).alias("citations"),
        F.least(i % 4, i % 3).alias("verified_citations"), (i % 1009 == 0).cast("int").alias("n_stale"), F.when(i % 5 != 0, (i % 10) / 10).alias("retrieval_precision"), (i % 6 == 0).alias("expect_abstention"), (i % 7 == 0).alias("abstained"), (i % 20 != 0).alias("behaved"), F.when(i % 2003 == 0, "boom").alias("error"),
    )


def corpus(spark, d):
    """Documents as what an ingestion made of them: sizes from the number of signs, states from the number."""
    i, n = F.col("doc_id"), F.coalesce("n_chars", F.lit(0))
    pages = F.ceil(n / 3000)
    return table(spark, d, "documents").select("doc_id", (i % 97 != 0).alias("succeeded"), (i % 41).alias("n_sections"), F.ceil(n / 700).alias("n_chunks"), pages.alias("n_pages"), F.when(F.col("source") == "src1", pages).otherwise(F.lit(0)).alias("n_ocr_pages"), (n / 2000).alias("duration_s"))


_CORPUS_SQL = """g AS (SELECT count(*) AS documents_attempted, count(*) FILTER (WHERE doc_id % 97 <> 0) AS documents_ingested, avg(CAST(doc_id % 97 <> 0 AS INTEGER)) AS ingestion_success_rate, count(*) FILTER (WHERE doc_id % 97 <> 0 AND doc_id % 41 = 0) AS documents_without_sections,
         CAST(sum(ceil(n_chars / 700)) AS BIGINT) AS total_chunks, CAST(sum(ceil(n_chars / 3000)) AS BIGINT) AS total_pages, sum(CASE WHEN source = 'src1' THEN ceil(n_chars / 3000) ELSE 0 END) / sum(ceil(n_chars / 3000)) AS ocr_page_rate,
         sum(ceil(n_chars / 700)) / (sum(CASE WHEN doc_id % 97 <> 0 THEN n_chars END) / 2000) AS embedding_throughput FROM documents)"""


@query(f"WITH {_CORPUS_SQL} SELECT * REPLACE (round(ingestion_success_rate, 6) AS ingestion_success_rate, round(ocr_page_rate, 6) AS ocr_page_rate, round(embedding_throughput, 6) AS embedding_throughput) FROM g", ingestion_success_rate="DOUBLE", ocr_page_rate="DOUBLE", embedding_throughput="DOUBLE")
def ingestion_metrics(spark, d):
    """What an ingestion reports: success, documents without sections, totals, share of OCR, throughput."""
    r = E.ingestion_report(corpus(spark, d))
    return r.select(*[F.round(c, 6).alias(c) if c in ("ingestion_success_rate", "ocr_page_rate", "embedding_throughput") else c for c in r.columns])


@query("""SELECT c_nationkey AS site, CASE WHEN bool_or(c_acctbal < -900) THEN 'unavailable' WHEN bool_or(c_acctbal < -500) THEN 'degraded' ELSE 'ok' END AS status,
       count(DISTINCT CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment END) = 2 AND coalesce(bool_and(CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_acctbal >= -500 END), false) AS can_answer, count(*) AS n_components FROM customer GROUP BY 1""")
def health_rollup(spark, d):
    """Customers as components of their nation: the worst state, and whether the required ones are all ok."""
    balance = F.col("c_acctbal")
    parts = table(spark, d, "customer").select(F.col("c_nationkey").alias("site"), F.col("c_mktsegment").alias("name"), F.when(balance < -900, "unavailable").when(balance < -500, "degraded").otherwise("ok").alias("status"))
    return H.roll_up(parts, ["site"], ("BUILDING", "MACHINERY"))


@query("""SELECT o_orderkey AS id, 'city' AS selected FROM orders WHERE o_custkey % 7 = 3 OR (o_custkey + 1) % 7 = 3 UNION ALL SELECT o_orderkey, 'behaviour' FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 9 = 0""")
def question_selectors(spark, d):
    """Orders as questions: those that expect one city, and those that are right to be declined or asked back."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    asked = table(spark, d, "orders").select(key.alias("id"), F.array((cust % 7).cast("string"), ((cust + 1) % 7).cast("string")).alias("expected_municipalities"), F.when(key % 4 != 0, key % 5 == 0).otherwise(F.when(key % 5 == 0, True)).alias("expect_abstention"), (key % 9 == 0).alias("expect_clarification"))
    return E.questions_for(asked, "3").select("id", F.lit("city").alias("selected")).unionByName(E.behavioural(asked).select("id", F.lit("behaviour").alias("selected")))


def measures(spark, d):
    """One row of all that the thresholds ask for: of the ingestion and of the validation runs."""
    ingested = E.ingestion_report(corpus(spark, d)).select("ingestion_success_rate", "documents_without_sections", "embedding_throughput")
    return E.validation_report(validation_runs(spark, d)).select("*", *[ingested.select(c).scalar().alias(c) for c in ingested.columns])


_P95 = "(SELECT vs[least(len(vs), CAST(floor(len(vs) * 0.95) AS BIGINT) + 1)] FROM (SELECT list_sort(list(CAST(floor(value * {m}) AS BIGINT))) AS vs FROM events WHERE floor(value * {m}) > 0 AND event_id % 2003 <> 0))"


@query(f"""WITH r AS (SELECT count(*) FILTER (WHERE event_id % 2003 = 0) AS errors, sum(least(event_id % 4, event_id % 3)) / sum(event_id % 4) AS citation_verification_rate,
         avg(CASE WHEN event_type = 'purchase' THEN CAST(event_id % 4 > 0 AS INTEGER) END) AS answers_with_citations, count(*) FILTER (WHERE event_id % 1009 = 0) AS stale_citations, avg(CASE WHEN event_id % 5 <> 0 THEN (event_id % 10) / 10 END) AS retrieval_precision,
         avg(CASE WHEN event_id % 6 = 0 THEN CAST(event_id % 7 = 0 AS INTEGER) END) AS correct_abstention_rate, avg(CASE WHEN event_id % 6 <> 0 THEN CAST(event_id % 7 = 0 AS INTEGER) END) AS false_abstention_rate, avg(CAST(event_id % 20 <> 0 AS INTEGER)) AS behaviour_accuracy,
         {_P95.format(m=10)} AS retrieval_p95_ms, {_P95.format(m=100)} AS answer_p95_ms FROM events),
       {_CORPUS_SQL},
       u AS (UNPIVOT (SELECT CAST(COLUMNS(*) AS DOUBLE) FROM (SELECT r.*, g.ingestion_success_rate, g.documents_without_sections, g.embedding_throughput FROM r CROSS JOIN g)) ON COLUMNS(*) INTO NAME name VALUE value)
       SELECT name, round(value, 6) AS value, CASE name WHEN 'errors' THEN value = 0 WHEN 'documents_without_sections' THEN value = 0 WHEN 'ingestion_success_rate' THEN value >= 1 WHEN 'embedding_throughput' THEN value >= 5 WHEN 'stale_citations' THEN value <= 0 WHEN 'false_abstention_rate' THEN value <= 0.2 WHEN 'retrieval_p95_ms' THEN value <= 2000 WHEN 'answer_p95_ms' THEN value <= 30000
         WHEN 'citation_verification_rate' THEN value >= 0.95 ELSE value >= 0.9 END AS passed, name NOT LIKE '%p95%' AND name <> 'embedding_throughput' AS blocking FROM u""")
def validation_thresholds(spark, d):
    """Validation measures against the acceptance thresholds."""
    return E.threshold_checks(measures(spark, d)).select("name", F.round("value", 6).alias("value"), "passed", "blocking")


@query("""WITH r AS (SELECT l_orderkey AS question_id, list(l_shipmode_ ORDER BY l_linenumber) AS retrieved, ['R'] AS expected FROM (SELECT *, l_returnflag AS l_shipmode_ FROM lineitem) GROUP BY 1 HAVING l_orderkey % 3 <> 0)
       SELECT question_id, round(len(list_filter(retrieved, lambda x: x = 'R')) / len(retrieved), 6) AS precision, array_to_string(list_sort(list_distinct(list_filter(retrieved, lambda x: x <> 'R'))), ',') AS leaked FROM r WHERE len(list_filter(retrieved, lambda x: x = 'R')) < len(retrieved)""")
def scope_leaks(spark, d):
    """Orders as questions about the city R, their lines' flags as the cities of what was retrieved: those with text of other cities."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("question_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda x: x["l_returnflag"]).alias("retrieved_municipalities"))
    expected = F.when(F.col("question_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("R")))  # some are about no city
    found = E.scope_leaks(lines.withColumn("expected_municipalities", expected))
    return found.select("question_id", F.round("precision", 6).alias("precision"), F.array_join("leaked", ",").alias("leaked"))


@query(r"""WITH c AS (SELECT doc_id, coalesce(text, '') AS answer, upper(lang) AS word, coalesce(source, '') AS forbidden, toxic = 1 AS should_abstain, quality = 0 AND toxic = 0 AS should_ask, coalesce(n_chars, 0) < 200 AS abstained, coalesce(n_chars, 0) BETWEEN 200 AND 300 AS asked FROM documents JOIN labels USING (doc_id))
       SELECT doc_id, contains(lower(answer), lower(word)) AS has_expected, contains(lower(answer), lower(forbidden)) OR contains(lower(answer), 'the') AS has_forbidden, CASE WHEN should_ask THEN asked WHEN should_abstain THEN abstained ELSE NOT abstained AND NOT asked END AS behaved FROM c""")
def case_flags(spark, d):
    """Documents as answers to rated cases: the flags that scoring needs, from the answers' texts."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    n = F.coalesce("n_chars", F.lit(0))
    cases = docs.select(
        "doc_id", F.col("text").alias("answer"), F.array(F.upper("lang")).alias("expected_answer_contains"), F.array(F.coalesce("source", F.lit("")), F.lit("THE")).alias("must_not_contain"), (F.col("toxic") == 1).alias("should_abstain"),
        ((F.col("quality") == 0) & (F.col("toxic") == 0)).alias("should_ask_clarification"), (n < 200).alias("abstained"), n.between(200, 300).alias("asked_clarification"),
    )
    return E.case_flags(cases).select("doc_id", "has_expected", "has_forbidden", "behaved")


@query("""WITH p AS (SELECT l_returnflag AS flag, list_sort(list(l_extendedprice)) AS vs FROM lineitem GROUP BY 1)
       SELECT flag, len(vs) AS n, vs[least(len(vs), CAST(floor(len(vs) * 0.5) AS BIGINT) + 1)] AS p50, vs[least(len(vs), CAST(floor(len(vs) * 0.95) AS BIGINT) + 1)] AS p95, vs[len(vs)] AS p100 FROM p""")
def percentiles_selected(spark, d):
    """Percentiles of all lines' prices by histograms that are refined around each rank; no task orders a group."""
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    return R.nearest_rank(rows, ["flag"], "l_extendedprice", {"p50": 0.5, "p95": 0.95, "p100": 1.0}, most_sorted=1000)
