"""Tables lifted from boxes, against what a person sees on the page."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docketspark import plans
from docketspark.operators import tables as TB

SCHEMA = "document_id string, page_number int, line_no long, text string, box struct<x0: double, y0: double, x1: double, y1: double>"


def page(spark, *lines, page_number=1):
    rows = [("d", page_number, i, text, box) for i, (text, *box) in enumerate(lines)]
    return spark.createDataFrame([(d, p, i, t, None if len(b) < 4 else tuple(map(float, b))) for d, p, i, t, b in rows], SCHEMA)


def test_a_table_between_prose(spark):
    lines = page(
        spark,
        ("Heading", 0, 0, 300, 10),
        ("Zone", 0, 20, 40, 30), ("Max |", 100, 20, 130, 30), ("Note", 200, 21, 240, 31),
        ("C-1", 0, 40, 30, 50), ("9.3\nm", 100, 41, 120, 50), ("long note", 200, 40, 290, 50), ("and more", 200, 45, 280, 58),
        ("C-2", 0, 60, 30, 70), ("see text", 195, 60, 240, 70),
        ("Prose again, which is one line.", 0, 80, 300, 90),
        ("a", 0, 100, 10, 110), ("1", 50, 100, 60, 110),
        ("Alone, so no table stands here.", 0, 120, 300, 130),
        ("no box",), ("flat", 0, 140, 0, 150),
    )
    found = TB.lift_tables(lines)
    (t,) = found.collect()
    assert t["rows"] == [["Zone", "Max |", "Note"], ["C-1", "9.3 m", "long note and more"], ["C-2", "", "see text"]]
    assert t["headers"] == ["Zone", "Max |", "Note"] and tuple(t["box"]) == (0, 20, 290, 70) and t["ordinal"] == 0
    assert t["markdown"].split("\n")[0] == "| Zone | Max \\| | Note |"
    left = {r["line_no"] for r in TB.prose_lines(lines, found).collect()}
    assert left == {0, 10, 11, 12, 13, 14, 15}
    assert TB.lift_tables(lines.limit(0)).count() == 0


def test_two_tables_and_numbers_first(spark):
    first = [(str(v), 100 * c, 20 * r, 100 * c + 40, 20 * r + 10) for r in range(3) for c, v in enumerate((r + 0.5, "1,000", "5%"))]
    second = [(v, 100 * c, 200 + 20 * r, 100 * c + 40, 210 + 20 * r) for r in range(2) for c, v in enumerate(("x", "y"))]
    lines = page(spark, *first, ("between", 0, 100, 300, 110), *second)
    a, b = TB.lift_tables(lines).orderBy("ordinal").collect()
    assert a["headers"] == [] and a["rows"][2] == ["2.5", "1,000", "5%"] and b["headers"] == ["x", "y"] and (a["ordinal"], b["ordinal"]) == (0, 1)
    both = lines.unionByName(page(spark, *second, page_number=2))
    assert TB.lift_tables(both.repartition(5)).groupBy("page_number").count().orderBy("page_number").collect() == [(1, 2), (2, 1)]
    assert TB.lift_tables(lines, min_rows=3).count() == 1 and TB.lift_tables(lines, min_columns=3).count() == 1


def test_pages_are_read_once_and_moved_once(spark, small):
    found = plans.QUERIES["lifted_tables"](spark, small)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_lines_left_are_counted_with_the_tables(spark):
    grid = [(v, 100 * c, y + 20 * r, 100 * c + 40, y + 20 * r + 10) for y in (0, 200) for r in range(2) for c, v in enumerate("xyz")]
    lines = page(spark, *grid, ("between", 0, 100, 300, 110), ("no box",), ("flat", 0, 5, 0, 5))
    lines = lines.unionByName(page(spark, ("prose only", 0, 0, 9, 9), page_number=2))
    found = TB.lift_tables(lines)
    assert [(r["ordinal"], r["n_prose"]) for r in found.orderBy("ordinal").collect()] == [(0, 3), (1, 3)]
    assert TB.prose_lines(lines, found).groupBy("page_number").count().orderBy("page_number").collect() == [(1, 3), (2, 1)]


@pytest.mark.parametrize("portion", [1, 7, 50])
def test_a_page_of_any_length_is_lifted_in_portions(monkeypatch, portion):
    rng, rows = random.Random(3), []
    for p, n in enumerate([1, 400, 3, 150]):
        lines = sorted((8.0 * rng.randrange(n // 2 + 1), float(rng.randrange(0, 300, 10))) for _ in range(n))
        rows += [("d", p, i + 1, n + 2, rng.choice(["a", "", "b|c", "1"]), y, x, y + 5, x + rng.choice([20, 90])) for i, (y, x) in enumerate(lines)]
    names = ["document_id", "page_number", "n", "of", "text", "y0", "x0", "y1", "x1"]
    whole = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])

    def lifted(batches):
        return pa.Table.from_batches(TB._lift(iter(batches), 2, 2, 1.0)).to_pylist()

    once = lifted([whole])
    assert len(once) > 20 and [t["ordinal"] for t in once if t["page_number"] == 1] == list(range(sum(t["page_number"] == 1 for t in once)))
    held, concat = [], pa.concat_batches
    monkeypatch.setattr(TB, "PORTION", portion)
    monkeypatch.setattr(TB.pa, "concat_batches", lambda batches: held.append(sum(b.num_rows for b in batches)) or concat(batches))
    assert lifted(whole.slice(i, portion) for i in range(0, whole.num_rows, portion)) == once
    assert max(held) < 150


@pytest.mark.parametrize(("text", "expected"), [("1,000", True), ("$5", True), ("25 %", True), ("-3.5", True), ("", False), ("%", False), ("9.3 m", False), ("1e3", True)])
def test_what_looks_numeric(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(TB.looks_numeric(F.col("t"))).first()[0] is expected


def test_only_what_begins_as_a_number_is_tried(spark):
    texts = ["inf", "-Infinity", "+iNF", "nan", "NaN", "1d", "0x1p3", "\x011", "+.5", ".5e3", ".", "e5", "India", "nano", "$ -7", "1_0", "٣", "--1", "Part", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.regexp_replace(F.regexp_replace("t", "[,%$]", ""), r"(?U)^\s+|\s+$", "")
    got = rows.select("t", TB.looks_numeric(F.col("t")).alias("numeric"), plain.try_cast("double").isNotNull().alias("cast")).collect()
    assert [r["t"] for r in got if bool(r["numeric"]) != r["cast"]] == [] and sum(r["cast"] for r in got) >= 9


def test_batches_of_lines_are_counted_by_rows_until_the_next_query(spark, small):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    plans.QUERIES["box_ratios"](spark, small)
    before = spark.conf.get(key)
    plans.QUERIES["lifted_tables"](spark, small)
    assert spark.conf.get(key) == str(2**31 - 1)
    plans.QUERIES["box_ratios"](spark, small)
    assert spark.conf.get(key) == before
