"""Rules found by a scan and by an index, overrides, and what becomes of questions, on small tables."""

import pytest
from pyspark.sql import functions as F

from docketspark.operators import answering
from docketspark.operators import compliance as C
from docketspark.operators.postings import TermIndex
from docketspark.session import ship

CHUNKS = [
    (1, "surrey", "in_force", False, "The maximum height of a pylon sign height is 7.5 m."),
    (2, "surrey", "in_force", False, "Pylon sign setback: a setback of no more than 2 m from the property line applies, maximum 2 m."),
    (3, "surrey", "superseded", False, "The maximum height of a pylon sign height is 1 m."),
    (4, "surrey", "in_force", False, "Fascia sign area shall not exceed 0.2 square metres per metre of building frontage."),
    (5, "burnaby", "in_force", False, "A pylon sign shall not exceed a maximum height of 20 feet."),
    (6, "burnaby", "in_force", True, "A pylon sign shall not exceed a maximum height of 1 m."),
    (7, "burnaby", "in_force", False, "A permit fee is payable. Heritage areas need design review."),
    (8, "richmond", "in_force", False, "Each pylon sign has a maximum height of 6 m; drawings are required."),
    (9, "richmond", "in_force", None, None),
]
SPECS = [(1, "pylon", "surrey", None, 7.0, 1.0, None), (2, "fascia", "surrey", 3.0, None, None, 20.0), (3, "fascia", "surrey", 3.0, None, None, None), (4, "pylon", "burnaby", None, 7.0, None, None), (5, "pylon", "hope", None, 7.0, None, None)]
VERDICTS = {(1, "height", 7.5, 1, "complies"), (1, "setback", 2.0, 2, "exceeds"), (2, "area", 4.0, 4, "complies"), (3, "area", None, 4, "indeterminate"), (4, "height", 6.096, 5, "exceeds"), (5, "height", None, None, "indeterminate")}


@pytest.fixture(scope="module")
def chunks(spark):
    ship(spark)
    return spark.createDataFrame(CHUNKS, "chunk_id long, municipality_slug string, document_status string, from_ocr boolean, body string")


@pytest.fixture(scope="module")
def index(chunks):
    return TermIndex(chunks, ("rules",), "chunk_id", "body")


@pytest.fixture(scope="module")
def specs(spark):
    return spark.createDataFrame(SPECS, "spec_id int, sign_type string, municipality_slug string, area double, height double, setback double, frontage double")


@pytest.mark.parametrize("searched", [False, True], ids=["scan", "index"])
def test_limits_decide(chunks, index, specs, searched):
    found = C.check(specs, chunks, index if searched else None).select("spec_id", "dimension", F.round("allowed", 6), "chunk_id", "verdict")
    assert {tuple(r) for r in found.collect()} == VERDICTS


@pytest.mark.parametrize("searched", [False, True], ids=["scan", "index"])
def test_checklists_and_comparisons(spark, chunks, index, searched):
    cities = spark.createDataFrame([("burnaby",), ("richmond",), ("hope",)], "municipality_slug string")
    by = index if searched else None
    got = {(r["municipality_slug"], r["topic"]): r["chunk_id"] for r in C.checklist(cities, chunks, index=by).filter("found").collect()}
    assert got == {("burnaby", "fees"): 7, ("burnaby", "heritage"): 7, ("richmond", "drawings"): 8}
    both = spark.createDataFrame([("surrey",), ("richmond",)], "municipality_slug string")
    compared = {(r["municipality_slug"], r["dimension"]): (r["value"], r["comparable"], r["lowest"], r["highest"]) for r in C.compare(both, chunks, "pylon", by).collect()}
    assert compared["surrey", "height"] == (7.5, True, False, True) and compared["richmond", "height"] == (6.0, True, True, False)
    if not searched:  # a search has other chunks in its best ones, and the first that states a limit decides
        assert compared["surrey", "setback"][:2] == (2.0, False) and compared["richmond", "setback"] == (None, False, False, False)


def test_references_of_document_heads(spark):
    from docketspark.operators.places import references

    texts = {
        "A bylaw to amend the City's Sign Bylaw No. 8789-2018.": [("8789-2018", True, False, False)],
        "As amended by Bylaw 12 and amendment No. 13. Bylaw No. 5": [("12", False, True, False), ("13", False, True, False), ("5", False, False, False)],
        "This repeals, in whole, By-law number 77; Bylaw 78 stays": [("77", False, False, True), ("78", False, False, False)],
        "Repealing bylaw # 9": [("9", False, False, True)],
        "No. 4 of the year": [("4", False, False, False)],
        "nothing": [],
    }
    given = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r[0]: [tuple(x) for x in r[1]] for r in given.select("t", references(F.col("t"))).collect()} == texts


def test_a_citys_own_terms_go_first(spark, chunks, index, specs):
    own = spark.createDataFrame([("burnaby", "pylon", "height", ["heritage", "design review"])], "municipality_slug string, sign_type string, dimension string, terms array<string>")
    wanted = spark.createDataFrame([("burnaby", "pylon", "height", ["pylon sign height", "maximum height"], ["m", "ft"]), ("surrey", "pylon", "height", ["pylon sign height"], ["m"])], "municipality_slug string, sign_type string, dimension string, terms array<string>, units array<string>")
    plain = {r["municipality_slug"]: r["chunk_id"] for r in C.limits_by_search(index, wanted, chunks, top=1).collect()}
    assert plain == {"burnaby": 5, "surrey": 1}
    with_own = {r["municipality_slug"]: r["chunk_id"] for r in C.limits_by_search(index, wanted, chunks, top=1, overrides=own).collect()}
    assert with_own == {"surrey": 1}  # the chunk that burnaby's terms find states no limit


def test_only_questions_without_an_answer_are_asked_again(spark, monkeypatch):
    ship(spark)
    rows = [
        (1, "surrey", "5", "a", "Bylaw A", "in_force", "fascia rules apply"),
        (2, "surrey", "5", "b", "Bylaw B", "in_force", "fascia rules differ"),
        (3, "surrey", "6", "c", "Bylaw C", "repealed", "awning rules of old"),
        (4, "surrey", "6", "d", None, "superseded", "awning rules, older"),
        (5, "delta", "1", "e", "Bylaw E", "in_force", "pylon heights"),
        (6, "delta", "1", "e", "Bylaw E", "in_force", "pylon setbacks"),
    ]
    chunks = spark.createDataFrame(rows, "id long, municipality_slug string, section_number string, document_id string, document_title string, document_status string, body string")
    index = TermIndex(chunks, ("outcomes",), text_col="body")
    asked = spark.createDataFrame([(1, "fascia"), (2, "awning"), (3, "pylon"), (4, "nowhere")], "query_id long, term string")
    calls = []
    search = index.search
    monkeypatch.setattr(index, "search", lambda asked, *a, **k: calls.append(sorted(r[0] for r in asked.select("query_id").distinct().collect())) or search(asked, *a, **k))
    got = {r["query_id"]: tuple(r)[1:] for r in answering.resolve(index, chunks, asked).collect()}
    assert calls == [[1, 2, 3, 4], [2, 4]]
    assert got[1] == ("conflicting_amendments", 2, 1, 1, []) and got[3][0] == "answered" and got[3][3] == 0 and got[4] == ("no_relevant", 0, None, 0, [])
    assert got[2][:2] == ("only_outdated", 0) and sorted(got[2][4]) == ["Bylaw C (repealed)", "Untitled (superseded)"]
    calls.clear()
    assert answering.resolve(index, chunks, asked.filter("query_id = 3")).first()["outcome"] == "answered" and len(calls) == 1
