"""Findings of a review at size: choices among ties, work a row, bounds of what a task holds."""

import datetime
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from compare import duck_rows, spark_rows
from pyspark.sql import functions as F

from docketspark import plans
from docketspark.functions import registry
from docketspark.functions import text as T
from docketspark.functions.limits import extract_limit
from docketspark.functions.varint import pack, unpack
from docketspark.operators import places, postings, retrieval


def test_of_tied_lines_the_first_of_the_table_stays(spark, tmp_path):
    def lines(keys, part):
        return spark.createDataFrame([(k, part * 1000 + i, 1, "R", "F", datetime.datetime(2020, 1, 1)) for i, k in enumerate(keys)], "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_shipdate timestamp")

    # readers take the larger file first, so it must not be the order of reading that decides
    for part, keys in enumerate(([1, 1, 2], [1, 2, *range(3, 900)])):
        lines(keys, part).coalesce(1).write.parquet(str(tmp_path / f"made-{part}"))
    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    for part in (0, 1):
        next((tmp_path / f"made-{part}").glob("part-*.parquet")).rename(folder / f"part-{part}.parquet")
    got = {r["l_orderkey"]: r["l_partkey"] for r in plans.QUERIES["distinct_citations"](spark, str(tmp_path)).collect()}
    assert got[1] == 0 and got[2] == 2 and len(got) == 899


def test_a_line_without_number_stands_last(spark, tmp_path):
    rows = [(1, 10, None), (1, 11, 2), (2, 20, None), (2, 21, None), (3, 30, 2), (3, 31, 1), (3, 32, 1)]
    lines = spark.createDataFrame([(*r, "R", "F", datetime.datetime(2020, 1, 1)) for r in rows], "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_shipdate timestamp")
    lines.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.sql("SET threads=1")  # on one thread it takes the first of the lines that its ORDER BY leaves open
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = spark_rows(plans.QUERIES["distinct_citations"](spark, str(tmp_path)))
    assert got == duck_rows(con.sql(plans.ORACLE_SQL["distinct_citations"])) and {r[2] for r in got[1]} == {"11", "20", "31"}


def test_a_limit_is_read_by_an_expression_of_bounded_size(spark):
    rows = spark.createDataFrame([("The height shall not exceed 5 m.",)], "t string")
    plan = rows.select(extract_limit(F.col("t")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all") <= 4


def test_a_date_is_read_from_one_cleaned_text(spark):
    rows = spark.createDataFrame([("march 3, 2018.",), ("July  15 2021",), ("May 2020",), ("no day",), ("",), (None,), ("2021/7/5",)], "t string")
    dates = rows.select(T.parse_date(F.col("t")).alias("day"))
    assert [r[0] for r in dates.collect()] == [datetime.date(2018, 3, 3), datetime.date(2021, 7, 15), datetime.date(2020, 5, 1), None, None, None, datetime.date(2021, 7, 5)]
    assert dates._jdf.queryExecution().analyzed().toString().count("initcap") == 1


def test_places_are_scanned_once_a_text(spark):
    r = registry.registry()
    assert r is registry.registry()
    for text in ("Surrey and Richmond, then Langley", "City of North Vancouver", "", "nowhere"):
        assert r.named(text) == (r.find(text), r.unresolved(text), r.last(text))
    head = spark.createDataFrame([("Adopted on March 3, 2018",)], "t string").select(places.dated(F.col("t"), places.ADOPTED).alias("day"))
    assert head.first()[0] == datetime.date(2018, 3, 3)


def test_blocks_are_opened_in_bounded_portions_and_only_for_the_asked(spark):
    docs = spark.createDataFrame([(i, f"common word{i % 50} other{i % 7} common") for i in range(400)], "id long, text string").coalesce(2)
    blocks = postings.blocks_of(docs, "id", "text").cache()
    want = sorted((r.term, r.id, r.tf, r.size) for r in postings.opened(blocks).collect())
    assert len(want) == 1200 and want[0] == ("common", 0, 2, 4)
    assert list(postings._portions(np.array([5, 1, 1, 9, 1]), 4)) == [(0, 1), (1, 3), (3, 4), (4, 5)]
    some = [3, 53, 399]
    assert sorted((r.term, r.id) for r in postings.terms_of(blocks, some).collect()) == [(t, i) for t, i, _, _ in want if i in some]


def test_a_search_moves_no_pairs_of_questions_and_texts(spark):
    docs = spark.createDataFrame([(i, f"common word{i % 5} own{i}") for i in range(100)], "id long, text string")
    index = postings.TermIndex(docs, ("pairs",))
    asked = spark.createDataFrame([(q, t) for q in range(4) for t in ("common", f"word{q}")], "query_id long, term string")
    found = index.search(asked, 30)
    rows = found.collect()
    assert len(rows) == 120 and {(r.query_id, r.id % 5) for r in rows if r["rank"] <= 20} == {(q, q) for q in range(4)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" in plan and ", id#" not in "".join(x for x in plan.splitlines() if "hashpartitioning(query_id" in x).split("ENSURE")[0]


def test_unpack_reads_slices(spark):
    packed = pack(np.array([1, 300, 5, 70000, 2]), np.array([2, 0, 2, 1]))
    assert unpack(packed).tolist() == [1, 300, 5, 70000, 2] and unpack(packed.slice(1, 2)).tolist() == [5, 70000] and unpack(packed.slice(1, 1)).tolist() == []


def test_pages_of_orders_are_drawn_in_one_pass(spark, small):
    from docketspark.plans.documents import order_pages

    pages = order_pages(spark, small)
    plan = pages._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Union" not in plan
    assert pages.filter("line_no = 9999").count() == pages.select("document_id").distinct().count()


def test_blocks_do_not_follow_batches(spark):
    docs = spark.createDataFrame([(i, None if i % 9 == 0 else f"common word{i % 50} common") for i in range(400)], "id long, text string").coalesce(1)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "16")
    try:
        rows = [r for r in postings.blocks_of(docs, "id", "text").collect() if r.term == "common"]
    finally:
        spark.conf.set(key, before)
    assert [(r.n, r.total) for r in rows] == [(355, 710)]


def test_a_block_is_built_in_bounded_memory():
    # a slice's words are found while those of earlier ones take four bytes each; terms are packed in portions
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 2000) % 50000) for _ in range(600)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 100)), pa.array(texts[i : i + 100])], names=["id", "text"]) for i in range(0, 600, 100)]
    tracemalloc.start()
    postings_of = sum(pc.sum(b.column("total")).as_py() for b in postings._blocks(iter(batches), None))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert postings_of == 600 * 2000 and peak < 80 << 20


def test_chunks_are_moved_before_they_are_wide(spark):
    chunks = spark.createDataFrame([(1, "a", "t", 1, 1, 10, 5, 1.5), (2, "b", "t", 2, 3, 10, None, 2.5), (3, "c", "t", 1, 1, 11, 6, 3.5), (4, "d", "t", 1, 1, 99, 5, 4.5), (5, "e", "t", None, 1, 12, 5, None)], "id long, body string, chunk_type string, page_number int, page_end int, document_id long, section_id long, score double")
    documents = spark.createDataFrame([(10, 7), (11, 8), (12, None)], "id long, municipality_id long").selectExpr("*", "concat('doc-', id) AS title", "'1' AS bylaw_number", "'in_force' AS status", *[f"DATE'2020-01-01' AS {c}" for c in ("consolidation_date", "last_amendment_date", "effective_date")])
    cities = spark.createDataFrame([(7, "seven", "Seven")], "id long, canonical_slug string, name string")
    sections = spark.createDataFrame([(5, "5", "5 > a", "A")], "id long, section_number string, full_path string, heading string")
    pages = spark.createDataFrame([(10, 1, True, 0.5, 1.0, 2.0), (11, 2, False, 0.5, 1.0, 2.0)], "document_id long, page_number int, was_ocred boolean, extraction_confidence double, width double, height double")
    found = retrieval.with_provenance(chunks, documents, cities, sections, pages, ("score",))
    assert len(found.columns) == 22
    rows = sorted((r.chunk_id, r.document_title, r.municipality_slug, r.section_number, r.from_ocr, r.score) for r in found.collect())
    assert rows == [(1, "doc-10", "seven", "5", True, 1.5), (2, "doc-10", "seven", None, None, 2.5), (3, "doc-11", None, None, None, 3.5), (5, "doc-12", None, "5", None, None)]

    def joins(node):
        if node.nodeName() == "Join":
            yield node.condition().toString(), node.output().mkString(" ")
        for k in range(node.children().size()):
            yield from joins(node.children().apply(k))

    of = {letter: out for condition, out in joins(found._jdf.queryExecution().optimizedPlan()) for letter in "msp" if f"_{letter}_" in condition}
    assert "body" not in of["m"] and "document_title" not in of["s"] + of["p"] and "section_path" not in of["p"]
