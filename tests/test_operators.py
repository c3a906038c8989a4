"""Operators on tiny tables: properties, ties, empties and brute-force versions."""

import datetime
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketspark.functions import registry as G
from docketspark.functions import text as T
from docketspark.operators import answers as A
from docketspark.operators import evaluation as E
from docketspark.operators import lineage as LN
from docketspark.operators import relational as R
from docketspark.operators import retrieval as V
from docketspark.operators import sections as S
from docketspark.operators import verify as Q


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_rrf_keeps_both_sides_and_checks_its_parameters(spark):
    def ranking(*ids):
        return spark.createDataFrame([(x, float(-i), i + 1) for i, x in enumerate(ids)], "id string, score double, rank int")

    fused = V.reciprocal_ranks(ranking("only-dense", "agreed", "x", "y"), ranking("z", "agreed", "w", "v"), ["id"], k=10)
    best = fused.orderBy(F.desc("fused_score"), "id").first()
    assert best["id"] == "agreed" and fused.count() == 7
    with pytest.raises(ValueError):
        V.reciprocal_ranks(ranking("a"), ranking("a"), ["id"], k=0)
    zero = V.reciprocal_ranks(ranking("a"), ranking("b"), ["id"], weights=(1.0, 0.0))
    assert {r["id"]: r["fused_score"] for r in zero.collect()}["b"] == 0.0


def test_knn_in_blocks_equals_brute_force_and_ignores_other_widths(spark):
    rng = np.random.default_rng(3)
    data = [(i, rng.normal(size=4).tolist()) for i in range(200)] + [(900, [1.0]), (901, None)]
    df = spark.createDataFrame(data, "id long, embedding array<double>").repartition(5)
    got = rows(V.knn(df, df.filter("id < 7"), 3, 4, block=2).select("query_id", "id", "rank"))
    m = np.array([v for _, v in data[:200]])
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    expected = []
    for q in range(7):
        order = sorted(range(200), key=lambda i: (-round(float(unit[q] @ unit[i]), 12), i))[:3]
        expected += [(q, i, k + 1) for k, i in enumerate(order)]
    assert got == sorted(expected, key=str)
    with pytest.raises(ValueError):
        V.knn(df, df.filter("id = 900"), 3, 4)
    assert V.knn(df, df.filter("id < 0"), 3, 4).count() == 0


def test_nearest_rank_on_small_groups(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 21)] + [("b", 5.0), ("c", None)], "g string, v double")
    assert rows(R.nearest_rank(df, ["g"], "v", {"p95": 0.95, "p50": 0.5})) == [("a", 20, 20.0, 11.0), ("b", 1, 5.0, 5.0)]


@pytest.mark.parametrize("most_sorted", [1 << 20, 0], ids=["window", "selection"])
def test_ranks_on_hard_values(spark, most_sorted):
    rng = random.Random(2)
    groups = {
        "spread": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(400)],
        "same": [7.25] * 50,
        "ends": [-1.7e308, 1.7e308, 0.0],
        "near": [1.0 + k * 2.0**-52 for k in range(300)],
        "one": [5.0],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("one", float("nan")), ("none", None)], "g string, v double").repartition(3)
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r["g"]: tuple(r)[1:] for r in R.nearest_rank(df, ["g"], "v", shares, most_sorted).collect()}
    assert got == {g: (len(vs), *(sorted(vs)[min(len(vs) - 1, int(len(vs) * p))] for p in shares.values())) for g, vs in groups.items()}
    whole = df.filter("g = 'one' and v = 5").select("g", F.lit(2**40).cast("long").alias("v"))
    assert R.nearest_rank(whole, ["g"], "v", {"p": 0.5}, most_sorted).first()["p"] == 2**40


def test_interval_join_takes_the_deepest_and_keeps_the_unmatched(spark):
    spans = spark.createDataFrame([(1, 0, 100, 1, 0), (1, 40, 60, 2, 1), (1, 50, 55, 2, 2)], "doc int, low int, high int, level int, idx int")
    points = spark.createDataFrame([(1, 52), (1, 5), (1, 500), (2, 5)], "doc int, page int")
    got = R.interval_join(points, spans, ["doc"], "page", "low", "high", "level", "idx", 7)
    assert rows(got.select("doc", "page", "idx")) == [(1, 5, 0), (1, 500, None), (1, 52, 1), (2, 5, None)]


def test_keyed_writes(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    changes = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, at int")
    assert rows(R.upsert(target, changes, ["k"], F.col("at"))) == [(1, "a"), (2, "y"), (3, "z")]
    assert rows(R.insert_ignore(target, changes, ["k"]).select("k")) == [(1,), (2,), (3,)]
    assert R.upsert(target.limit(0), changes.limit(0), ["k"], F.col("at")).count() == 0
    good, bad = R.quarantine(target, {"one": F.col("k") == 1})
    assert rows(good) == [(1, "a")] and rows(bad) == [(2, "b", ["one"])]


DAY = datetime.date


def facts(spark, *given):
    schema = "document_id string, municipality_slug string, bylaw_number string, doc_type string, consolidation_date date, effective_date date, year int, amends array<string>, repeals array<string>"
    return spark.createDataFrame(list(given), schema)


def test_lineage_of_consolidations_amendments_and_repeals(spark):
    f = facts(
        spark,
        ("old", "surrey", "100", "consolidated", DAY(2015, 1, 1), None, None, [], []),
        ("new", "surrey", "0100-2015", "consolidated", DAY(2021, 6, 1), None, None, [], []),
        ("absorbed", "surrey", "200", "amendment", None, DAY(2020, 1, 1), None, ["100"], []),
        ("pending", "surrey", "201", "amendment", None, DAY(2022, 1, 1), None, ["100"], []),
        ("other-city", "burnaby", "100", "base", None, DAY(1990, 1, 1), None, [], []),
        ("gone", "burnaby", "7", "base", None, DAY(1990, 1, 1), None, [], []),
        ("repealer", "burnaby", "8", "base", None, DAY(2000, 1, 1), None, [], ["7", "8"]),
        ("nameless", "burnaby", None, "base", None, DAY(2000, 1, 1), None, [], []),
        ("undated", "delta", "5", "base", None, None, None, [], []),
    )
    status = {r["document_id"]: (r["status"], r["last_amendment_date"]) for r in LN.resolve(f).collect()}
    assert status["old"][0] == "superseded" and status["new"] == ("in_force", DAY(2022, 1, 1))
    assert status["absorbed"][0] == "superseded" and status["pending"][0] == "in_force"
    assert status["other-city"][0] == "in_force" and status["gone"][0] == "repealed" and status["repealer"][0] == "in_force"
    assert status["nameless"][0] == "unknown" and status["undated"][0] == "unknown"
    assert ("old", "new", "consolidates", 0.75) in rows(LN.edges(f)) and ("old", "absorbed", "amends", 0.4) in rows(LN.edges(f))


def test_verified_status_is_kept(spark):
    docs = spark.createDataFrame([("a", "repealed", True, None), ("b", "unknown", False, None)], "document_id string, status string, verified_by_human boolean, last_amendment_date date")
    new = spark.createDataFrame([("a", "in_force", None), ("b", "in_force", DAY(2020, 1, 1))], "document_id string, status string, last_amendment_date date")
    assert rows(LN.apply_status(docs, new).select("document_id", "status")) == [("a", "repealed"), ("b", "in_force")]


def test_verification_and_abstention(spark):
    chunks = spark.createDataFrame([("c1", "Signs must not\nexceed 9.3 m in height at the front of any building."), ("c2", "A permit is required.")], "chunk_id string, body string")
    sources = spark.createDataFrame([(a, s, f"c{s}") for a in (1, 2, 3) for s in (1, 2)], "answer_id int, source_id int, chunk_id string")
    claims = spark.createDataFrame([(1, 1, "signs must not exceed 9.3 m"), (2, 1, "never said"), (2, 7, "x"), (3, 2, "A permit is required"), (3, 1, "")], "answer_id int, source_id int, quote string")
    answers = spark.createDataFrame([(1, "Signs must not exceed 9.3 m [S1]."), (2, "It must be 5 m."), (3, "A permit is required [S2] and 12 m."), (4, "Hello.")], "answer_id int, answer string")
    got = {r["answer_id"]: r for r in Q.verify_answers(answers, Q.check_claims(claims, sources, chunks)).collect()}
    assert not got[1]["abstain"] and got[1]["precision"] == 1.0
    assert got[2]["reason"] == "no verified citation" and got[2]["n_invalid"] == 2
    assert got[3]["reason"] == "citations fail" and not got[4]["abstain"]


def test_long_quotes_may_differ_at_the_end(spark):
    df = spark.createDataFrame([("one two three four five six seven eight nine ten", "0 one two three four five six seven and so on"), ("one two three", "one two"), ("", "x"), ("STRASSE", "die Straße")], "q string, b string")
    assert [r[0] for r in df.select(T.quote_in(F.col("q"), F.col("b"))).collect()] == [True, False, False, True]
    longer = spark.createDataFrame([("a b c d e f g h i", "z a b c d e f tail")], "q string, b string")
    assert longer.select(T.quote_in(F.col("q"), F.col("b"))).first()[0]


def test_confidence_bands(spark):
    schema = "answer_id int, document_id string, section_number string, municipality_slug string, status string, final_score double, from_ocr boolean, extraction_confidence double, cited boolean"
    chunks = spark.createDataFrame([(1, "d", "5", "surrey", "in_force", 1.0, False, 1.0, True), (1, "e", "6", "surrey", "in_force", 0.1, False, 1.0, True), (1, "f", "7", "surrey", "in_force", 0.1, False, 1.0, True), (2, "d", "5", "surrey", "superseded", 1.0, False, 1.0, True)], schema)
    answers = spark.createDataFrame([(1, 1.0, 3, 0, False, False), (2, 1.0, 1, 0, False, False), (3, 1.0, 0, 0, False, False)], "answer_id int, precision double, n_cited int, n_uncited int, abstained boolean, conflict boolean")
    got = {r["answer_id"]: (r["score"], r["band"]) for r in A.confidence(chunks, answers).collect()}
    assert got[1] == (1.0, "high") and got[2][1] == "low" and got[3] == (0.0, "insufficient")


def test_milestone(spark):
    checks = spark.createDataFrame([("a", 1.0, True, True), ("b", 1.0, False, False)], "name string, value double, passed boolean, blocking boolean")
    assert E.milestone_passed(checks).first()[0] and not E.milestone_passed(checks.withColumn("blocking", F.lit(True))).first()[0]


def test_registry():
    g = G.Registry()
    assert g.find("Signs in the City of Langley and New Westminster") == ["langley-city", "new-westminster"]
    assert g.find("North Vancouver") == [] and g.unresolved("North Vancouver") == ["north-vancouver"]
    assert g.find("Burnaby, Vancouver") == ["burnaby", "vancouver"] and g.find("Vancouverite") == []


def test_packing_rules():
    units = ["w" * 36] * 10
    packed = S.pack(units, 30, 100, 0)
    assert " ".join(packed).split() == units and all(S.tokens_of(p) <= 31 for p in packed)
    with_tail = S.pack(units, 30, 100, 5)
    assert all(a.split()[-1] == b.split()[0] for a, b in itertools.pairwise(with_tail))
    assert S.pack(["x y " * 400], 50, 100, 0) and S.pack([], 5, 5, 0) == []


def test_chunks_hold_their_sections(spark):
    body = "“Sign” means a thing.\n“Wall” means another thing."
    sections = spark.createDataFrame([(1, 0, "1", "Definitions", 1, 1, body), (1, 1, "2", "Rules", 2, 3, "A rule. " * 400), (1, 2, "3", "Empty", 3, 3, "  ")], "doc_id long, idx long, section_number string, heading string, page_start int, page_end int, body string")
    got = S.chunk_sections(sections, target=100, most=150, overlap=10).orderBy("ordinal").collect()
    assert [r["chunk_type"] for r in got[:3]] == ["definition", "definition", "parent"] and {r["parent_ordinal"] for r in got[3:]} == {2}
    assert {r["section_idx"] for r in got} == {0, 1}


def test_chunks_join_across_sections_and_take_tables_whole(spark):
    schema = "doc_id long, idx long, section_number string, heading string, level int, full_path string, page_start int, page_end int, body string"
    rows_of = [
        (1, 0, "5", "Signs", 1, "5", 1, 1, "A first rule of some length. " * 8),
        (1, 1, "5", "Signs", 1, "5", 2, 2, "Short end."),  # the same heading again, on the next page
        (1, 2, "6", "Walls", 1, "6", 2, 4, "Tiny."),
        (1, 3, "6.1", "Walls", 2, "6 > 6.1", 3, 3, "Tiny too."),
        (2, 0, "1", "Other", 1, "1", 1, 1, "Alone."),
        (3, 0, "1", "Empty", 1, "1", 1, 1, None),
    ]
    tables = spark.createDataFrame([(1, 3, 0, "Areas", "| a |"), (1, 2, 0, None, "| b |"), (1, 9, 0, "", "| c |"), (3, 1, 0, None, "| d |")], "doc_id long, page_number int, ordinal int, caption string, markdown string")
    got = S.chunk_sections(spark.createDataFrame(rows_of, schema).repartition(4), target=100, most=150, overlap=0, least=12, tables=tables).collect()
    assert [r["section_idx"] for r in sorted(got, key=lambda r: (r["doc_id"], r["ordinal"]))] == [0, 2, 3, 1, 3, None, 0, 0]
    by_doc = {d: [(r["ordinal"], r["chunk_type"], r["body"], r["page_start"], r["page_end"]) for r in sorted(got, key=lambda r: r["ordinal"]) if r["doc_id"] == d] for d in (1, 2, 3)}
    assert by_doc[1] == [
        (0, "prose", "[5 Signs]\n" + ("A first rule of some length. " * 8).strip() + " Short end.", 1, 2),
        (1, "prose", "[6 Walls]\nTiny.", 2, 4),
        (2, "prose", "[6.1 Walls]\nTiny too.", 3, 3),
        (3, "table", "| b |", 2, 2),
        (4, "table", "Areas\n| a |", 3, 3),
        (5, "table", "| c |", 9, 9),
    ]
    assert by_doc[2] == [(0, "prose", "[1 Other]\nAlone.", 1, 1)] and by_doc[3] == [(0, "table", "| d |", 1, 1)]
    assert S.chunk_sections(spark.createDataFrame([], schema)).count() == 0


def test_dates_and_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, line_no int, text string, page_number int, font_size double, is_bold boolean")
    assert S.parse_sections(empty).count() == 0
    assert facts(spark).count() == 0 and LN.resolve(facts(spark)).count() == 0


def test_web_queries(spark):
    from docketspark.operators import fulltext

    assert fulltext.parse('a "b c" -d or -"e f" OR') == [[fulltext.Clause(("a",), False), fulltext.Clause(("b", "c"), False), fulltext.Clause(("d",), True)], [fulltext.Clause(("e", "f"), True)]]
    df = spark.createDataFrame([("The sign area, of a wall.",), ("area sign",), (None,)], "t string")
    got = [r[0] for r in df.select(fulltext.matches(F.col("t"), '"sign area" -roof')).collect()]
    assert got == [True, False, False]
    assert [r[0] for r in df.select(fulltext.matches(F.col("t"), " - ")).collect()] == [False] * 3


def test_missing_measures_fail(spark):
    report = spark.createDataFrame([(0, 0.95)], "stale_citations int, behaviour_accuracy double")
    checks = {r["name"]: (r["value"], r["passed"], r["blocking"]) for r in E.threshold_checks(report).collect()}
    assert set(checks) == set(E.THRESHOLDS) and checks["behaviour_accuracy"] == (0.95, True, True) and checks["ingestion_success_rate"] == (None, False, True)
    assert not E.milestone_passed(E.threshold_checks(report)).first()[0]
    asked = E.threshold_checks(report.withColumn("uncovered_city_abstains", F.lit(False)))
    assert asked.filter("name = 'uncovered_city_abstains' and not passed and blocking").count() == 1


def test_health(spark, small, tmp_path):
    from docketspark.operators import health

    good = health.check(spark, small, ("documents", "embeddings"), embedder=object(), generator=object())
    assert health.roll_up(good).first()["can_answer"] and health.roll_up(good).first()["status"] == "ok"
    less = health.check(spark, small, ("documents", "embeddings", "nothing"), embedder=object(), generator=object())
    assert health.roll_up(less).first()["status"] == "degraded"
    none = health.check(spark, str(tmp_path), ("documents", "embeddings"))
    assert health.roll_up(none).first()["status"] == "unavailable" and not health.roll_up(none).first()["can_answer"]
    assert not health.roll_up(good.filter("name != 'generator'")).first()["can_answer"]


def test_a_reranker_that_fails_leaves_the_fused_order(spark):
    pool = spark.createDataFrame([(1, 10, 0.3, 0.9), (1, 11, 0.2, None), (2, 10, 0.1, 0.5), (2, 11, 0.2, 0.1)], "q int, id int, fused_score double, s double")
    got = {(r["q"], r["rank"]): (r["id"], r["final_score"]) for r in V.rerank(pool, F.col("s"), 2, ["q"], "id").collect()}
    assert got == {(1, 1): (10, 0.3), (1, 2): (11, 0.2), (2, 1): (10, 0.5), (2, 2): (11, 0.1)}


def test_words_of_page_quality(spark):
    from docketspark.functions.text import page_quality

    odd = ["bcdfghj", "a" * 41, "bcdfghja", "x" * 41, "plain", "I", "sphynxs", "bcdfgh", "b1cdfghjkl", ""]
    for w in odd:
        words = re.findall("[A-Za-z]{2,}", w)
        fine = [x for x in words if len(x) <= 40 and (len(x) <= 6 or re.search("[aeiouyAEIOUY]", x))]
        got = spark.createDataFrame([(w,)], "t string").select(page_quality(F.col("t"))["plausibility"]).first()[0]
        assert got == (len(fine) / len(words) if words else 0.0), w


def test_box_join_finds_what_all_pairs_find(spark):
    rng = random.Random(5)
    side = [0.0, 0.05, 0.1, 0.2, 0.4]

    def box():
        x, y = rng.choice([0.0, -0.3, 0.1, rng.uniform(-1, 1)]), rng.choice([0.0, 0.2, rng.uniform(-1, 1)])
        return x, y, x + rng.choice(side), y + rng.choice(side)

    lines = [(i, i % 2, box()) for i in range(150)] + [(900, 0, None), (901, None, (0.0, 0.0, 1.0, 1.0))]
    tables = [(i, i % 2, box()) for i in range(150)] + [(900, 0, None), (901, 1, (-3.0, -3.0, 3.0, 3.0))]
    kind = "x0 double, y0 double, x1 double, y1 double"
    a, b = spark.createDataFrame(lines, f"line int, page int, lb struct<{kind}>"), spark.createDataFrame(tables, f"tab int, page int, tb struct<{kind}>")
    every = a.join(b, "page").withColumn("share", R.overlap_share(F.col("lb"), F.col("tb"))).filter("share >= 0.5")
    found = R.box_join(a, b, ["page"], "lb", "tb", 0.1)
    pick = lambda d: sorted((r.line, r.tab, r.share) for r in d.select("line", "tab", "share").collect())
    assert pick(found) == pick(every) and len(pick(found)) > 150
    with pytest.raises(ValueError):
        R.box_join(a, b, ["page"], "lb", "tb", 0.1, 0.4)
