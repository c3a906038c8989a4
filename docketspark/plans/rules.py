"""Questions, addresses, metadata, zoning and compliance over texts that customers and parts write: the tables hold no bylaws."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from docketspark.operators import compliance as C
from docketspark.operators import places as P
from docketspark.operators.postings import TermIndex
from docketspark.plans.registry import query
from docketspark.plans.text import each, each_sql, rows
from docketspark.session import table

_QUESTIONS = [
    ("What are the sign rules in Langley?", "definition", "", "langley", "", ""),
    ("What is the population of Surrey?", "out_of_scope", "surrey", "", "", ""),
    ("What is the maximum fascia sign area in the City of Langley?", "single_city", "langley-city", "", "fascia", ""),
    ("Compare pylon sign heights in Surrey and Richmond", "multi_city_compare", "surrey,richmond", "", "pylon", ""),
    ("Is an awning permitted in C-2 and RS-1?", "keyword", "", "", "awning", "C-2,RS-1"),
    ("What counts as a freestanding sign?", "definition", "", "", "freestanding", ""),
    ("Temporary signs in North Vancouver", "keyword", "", "north-vancouver", "temporary", ""),
    ("  ", "out_of_scope", "", "", "", ""),
    ("How high may a sign in Port Coquitlam be?", "single_city", "port-coquitlam", "", "", ""),
]


@query(f"SELECT * FROM {each_sql('intent, cities, ambiguous, sign_types, zones', *[x[1:] for x in _QUESTIONS])}")
def route_questions(spark, d):
    """Intent, cities, ambiguous names, sign types and zones of customers' questions."""
    found = P.route(each(spark, d, "question string", *[x[:1] for x in _QUESTIONS]))
    return found.select("key", "intent", *[F.array_join(c, ",").alias(c) for c in ("cities", "ambiguous", "sign_types", "zones")])


_ADDRESSES = [
    ("# Main Street, Burnaby", "resolved", "burnaby", "# Main Street", ""),
    ("# Burnaby Street, Vancouver", "resolved", "vancouver", "# Burnaby Street", ""),
    ("# Esplanade, City of North Vancouver", "resolved", "north-vancouver-city", "# Esplanade", ""),
    ("# Main Street, Langley", "ambiguous_municipality", None, None, "City of Langley|Township of Langley"),
    ("Main Street, Burnaby", "no_civic_number", None, None, ""),
    ("# Main Street", "no_municipality", None, None, ""),
    ("12-3# Oak Ave, Surrey, BC V3T 1A1", "resolved", "surrey", "12-3# Oak Ave", ""),
]


@query(f"SELECT * FROM {each_sql('outcome, municipality_slug, street_address, candidates', *[x[1:] for x in _ADDRESSES])}")
def parse_addresses(spark, d):
    """Customers' addresses and their four outcomes."""
    found = P.parse_addresses(each(spark, d, "address string", *[x[:1] for x in _ADDRESSES]))
    return found.select("key", "outcome", "municipality_slug", "street_address", F.array_join("candidates", "|").alias("candidates"))


_COVER = "CITY OF COQUITLAM\nSIGN BYLAW NO. 4#, 2019\nConsolidated for convenience to July 15, 2021\n"
_META = [
    (1, "a.pdf", _COVER, "coquitlam", "4#", 2021, "2021-07-15", "consolidated", "", "", 1.0),
    (2, "burnaby_sign_bylaw_13#_2020.pdf", "", "burnaby", "13#", 2020, None, "unknown", "", "", 0.68),
    (3, "x.pdf", "District of Saanich\nA bylaw to amend the Sign Bylaw No. 8#. Adopted on March 3, 2018. This repeals Bylaw No. 77.", "saanich", "8#", 2018, None, "amendment", "", "77", 0.96),
    (4, "y.pdf", "Surrey and Richmond and Delta", None, None, None, None, "unknown", "", "", 0.0),
]


@query(f"SELECT key, municipality_slug, bylaw_number, CAST(year AS INTEGER) AS year, CAST(consolidation_date AS DATE) AS consolidation_date, doc_type, amends, repeals, CAST(confidence AS DOUBLE) AS confidence FROM {each_sql('municipality_slug, bylaw_number, year, consolidation_date, doc_type, amends, repeals, confidence', *[x[3:] for x in _META])}")
def document_metadata(spark, d):
    """Identity of documents from their first pages and file names, which customers' numbers stand in."""
    given = each(spark, d, "filename string, page string", *[x[1:3] for x in _META])
    found = P.detect_metadata(given.select("key", "filename", F.array("page").alias("page_texts")))
    return found.select("key", "municipality_slug", "bylaw_number", "year", "consolidation_date", "doc_type", F.array_join("amends", ",").alias("amends"), F.array_join("repeals", ",").alias("repeals"), "confidence")


_LOOKUPS = [("surrey", "resolved", "C-#"), ("surrey", "resolved", "R-#"), ("surrey", "stale", "S-#"), ("surrey", "not_found", None), ("hope", "stale", "H-#"), ("hope", "unsupported", None), (None, "unsupported", None), ("surrey", "not_found", None)]


@query(f"SELECT municipality_slug, CAST(key AS VARCHAR) || ' main st' AS normalized_address, outcome, zone FROM {each_sql('municipality_slug, outcome, zone', *_LOOKUPS)}")
def zoning_outcomes(spark, d):
    """Zoning lookups of customers' addresses: fresh and stale cache, verified and unverified providers, ambiguous answers."""
    now = datetime.datetime(2024, 1, 31)
    day = datetime.timedelta(days=1)
    kind, number = F.col("key") % len(_LOOKUPS), (F.col("key") % 900 + 100).cast("string")
    asked = each(spark, d, "municipality_slug string", *[x[:1] for x in _LOOKUPS]).withColumn("normalized_address", F.concat(F.col("key").cast("string"), F.lit(" main st")))

    def of(letter, *kinds):
        return asked.filter(kind.isin(*kinds)).select("municipality_slug", "normalized_address", F.concat(F.lit(letter), number).alias("zone"))

    fresh, stale, gone = of("C-", 0).withColumn("expires_at", F.lit(now + day)), of("S-", 2), of("H-", 4)
    cache = fresh.unionByName(stale.unionByName(gone).withColumn("expires_at", F.lit(now - day)))
    providers = rows(spark, "municipality_slug string, verified boolean", ("surrey", True), ("hope", False))
    answers = of("R-", 1, 5, 7).unionByName(of("B-", 7))
    return P.zoning_lookup(asked.select("municipality_slug", "normalized_address"), cache, providers, answers, F.lit(now))


_BODY = """p_name || CASE p_partkey % 4 WHEN 0 THEN ': the maximum height of a pylon sign is ' || p_size || ' m.' WHEN 1 THEN ': a pylon sign keeps a setback of no more than ' || p_size || ' m from the property line.'
         WHEN 2 THEN ': pylon sign area shall not exceed ' || p_size || ' square metres.' ELSE ': drawings, and a permit fee of ' || p_size || ' dollars.' END"""
_BM25 = f"""ch AS (SELECT p_partkey AS id, p_brand AS city, p_size % 7 <> 0 AND p_size % 11 <> 0 AS ok, {_BODY} AS body, p_partkey % 4 AS kind, p_size AS size_m FROM part),
       tk AS (SELECT id, unnest(list_filter(string_split_regex(lower(body), '[^a-z0-9]+'), lambda t: t <> '')) AS term FROM ch),
       po AS (SELECT id, term, count(*) AS tf FROM tk GROUP BY ALL), sz AS (SELECT id, count(*) AS size FROM tk GROUP BY 1), st AS (SELECT count(*) AS n, avg(size) AS mean FROM sz), df AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
       s AS (SELECT city, q, id, kind, size_m, body, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 9) AS score
             FROM qs JOIN po USING (term) JOIN df USING (term) JOIN sz USING (id) JOIN ch USING (id) CROSS JOIN st WHERE ok GROUP BY ALL)"""
_RULE_WORDS = "qs AS (SELECT q, unnest(ws) AS term FROM (VALUES ('height', ['pylon', 'sign', 'height', 'maximum']), ('setback', ['setback', 'property', 'line', 'pylon']), ('area', ['pylon', 'sign', 'freestanding', 'area'])) t(q, ws))"
_LIMITS_SQL = f"""{_RULE_WORDS}, {_BM25},
       r AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY city, q ORDER BY score DESC, id) <= 5),
       lim AS (SELECT city, q AS dimension, id AS chunk_id, size_m AS value, CASE q WHEN 'area' THEN 'm2' ELSE 'm' END AS unit FROM r WHERE CASE q WHEN 'area' THEN kind = 2 ELSE kind IN (0, 1) END
               QUALIFY row_number() OVER (PARTITION BY city, q ORDER BY score DESC, id) = 1)"""
_SPEC_SQL = "sp AS (SELECT s_suppkey AS spec_id, 'Brand#' || (s_suppkey % 27 + 1) AS city, unnest(['area', 'height', 'setback']) AS dimension, unnest([s_suppkey % 30, s_suppkey % 50, s_suppkey % 20])::DOUBLE AS proposed FROM supplier)"
_CHECK_SQL = f"""{_LIMITS_SQL}, {_SPEC_SQL},
       v AS (SELECT spec_id, dimension, CAST(value AS DOUBLE) AS allowed, chunk_id, CASE WHEN value IS NULL THEN 'indeterminate' WHEN CASE dimension WHEN 'setback' THEN proposed >= value ELSE proposed <= value END THEN 'complies' ELSE 'exceeds' END AS verdict
             FROM sp LEFT JOIN lim USING (city, dimension))"""


def rule_chunks(spark, d):
    """Parts as chunks of rules, which their sizes stand in: the brand is the city, and some are out of force or read by OCR."""
    size = F.col("p_size")
    number = size.cast("string")
    kind = F.col("p_partkey") % 4
    said = (
        F.when(kind == 0, F.concat(F.lit(": the maximum height of a pylon sign is "), number, F.lit(" m.")))
        .when(kind == 1, F.concat(F.lit(": a pylon sign keeps a setback of no more than "), number, F.lit(" m from the property line.")))
        .when(kind == 2, F.concat(F.lit(": pylon sign area shall not exceed "), number, F.lit(" square metres.")))
        .otherwise(F.concat(F.lit(": drawings, and a permit fee of "), number, F.lit(" dollars.")))
    )
    status = F.when(size % 7 == 0, "superseded").otherwise("in_force")
    parts = table(spark, d, "part")
    chunks = parts.select(F.col("p_partkey").alias("chunk_id"), F.col("p_brand").alias("municipality_slug"), status.alias("document_status"), (size % 11 == 0).alias("from_ocr"), F.concat("p_name", said).alias("body"))
    return chunks, TermIndex(chunks, ("part rules", d), "chunk_id", "body", source=parts)


def sign_specs(spark, d):
    """Suppliers' proposed pylon signs."""
    key = F.col("s_suppkey")
    city = F.concat(F.lit("Brand#"), (key % 27 + 1).cast("string"))  # two of the cities have no rules
    return table(spark, d, "supplier").select(key.alias("spec_id"), F.lit("pylon").alias("sign_type"), city.alias("municipality_slug"), (key % 30).cast("double").alias("area"), (key % 50).cast("double").alias("height"), (key % 20).cast("double").alias("setback"), F.lit(None).cast("double").alias("frontage"))


@query(f"WITH {_CHECK_SQL} SELECT * FROM v")
def compliance_check(spark, d):
    """Suppliers' signs against the limits that each city's best chunks in force state, found in an index of all chunks."""
    return C.check(sign_specs(spark, d), *rule_chunks(spark, d)).select("spec_id", "dimension", "allowed", "chunk_id", "verdict")


@query(f"WITH {_CHECK_SQL} SELECT spec_id, CASE max(CASE verdict WHEN 'exceeds' THEN 2 WHEN 'indeterminate' THEN 1 ELSE 0 END) WHEN 2 THEN 'exceeds' WHEN 1 THEN 'indeterminate' ELSE 'complies' END AS verdict FROM v GROUP BY 1")
def compliance_rollup(spark, d):
    """The gravest verdict of each supplier's sign."""
    return C.check(sign_specs(spark, d), *rule_chunks(spark, d)).groupBy("spec_id").agg(C.worst(F.col("verdict")).alias("verdict"))


_TOPICS = ", ".join(f"('{t}', {[*dict.fromkeys(' '.join(terms).split())]!r}, {list(terms)!r})" for t, terms in C.TOPICS)


@query(f"""WITH qs AS (SELECT q, unnest(ws) AS term FROM (VALUES {_TOPICS}) t(q, ws, terms)), {_BM25},
       r AS (SELECT s.*, row_number() OVER (PARTITION BY city, s.q ORDER BY score DESC, id) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY city, s.q ORDER BY score DESC, id) <= 3),
       b AS (SELECT city, r.q, arg_min(id, rank) AS chunk_id FROM r JOIN (VALUES {_TOPICS}) t(q, ws, terms) ON t.q = r.q WHERE len(list_filter(terms, lambda t: contains(lower(body), t))) > 0 GROUP BY 1, 2)
       SELECT c.city AS municipality_slug, t.q AS topic, chunk_id IS NOT NULL AS found, chunk_id FROM (SELECT DISTINCT p_brand AS city FROM part) c CROSS JOIN (VALUES {_TOPICS}) t(q, ws, terms) LEFT JOIN b ON b.city = c.city AND b.q = t.q""")
def permit_checklist(spark, d):
    """What each city's chunks in force say to the topics of a permit."""
    chunks, index = rule_chunks(spark, d)
    return C.checklist(chunks.select("municipality_slug").distinct(), chunks, index=index).select("municipality_slug", "topic", "found", "chunk_id")


@query(f"""WITH {_LIMITS_SQL}, c AS (SELECT DISTINCT p_brand AS city FROM part),
       a AS (SELECT city, dimension, value, unit, count(value) OVER w >= 2 AS many, min(value) OVER w AS low, max(value) OVER w AS high FROM c CROSS JOIN (VALUES ('area'), ('height'), ('setback')) t(dimension) LEFT JOIN lim USING (city, dimension) WINDOW w AS (PARTITION BY dimension))
       SELECT city AS municipality_slug, dimension, CAST(value AS DOUBLE) AS value, unit, many AS comparable, coalesce(many AND value = low, false) AS lowest, coalesce(many AND value = high, false) AS highest FROM a""")
def municipality_comparison(spark, d):
    """Limits of all cities side by side."""
    chunks, index = rule_chunks(spark, d)
    return C.compare(chunks.select("municipality_slug").distinct(), chunks, "pylon", index).select("municipality_slug", "dimension", "value", "unit", "comparable", "lowest", "highest")
