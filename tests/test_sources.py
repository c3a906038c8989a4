import json

from pyspark.sql import functions as F

from docketspark.sources import files as S
from docketspark.sources import zoning as Z
from docketspark.streaming import ingest as I


def test_discover_hash_and_skip_known(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "One.PDF").write_bytes(b"%PDF-1")
    (tmp_path / "two.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "big.pdf").write_bytes(b"x" * 100)
    (tmp_path / "note.txt").write_bytes(b"n")
    found = [r["path"].rsplit("/", 1)[1] for r in S.discover(spark, str(tmp_path), most_bytes=50).collect()]
    assert found == ["One.PDF", "two.pdf"]
    hashed = S.hashed(spark, str(tmp_path))
    assert S.new_documents(hashed, hashed.limit(0)).count() == 3 and S.new_documents(hashed, hashed).count() == 0


def test_lines_isolate_failures(spark):
    files = spark.createDataFrame([("good", bytearray(b"a\nb\fc")), ("bad", bytearray(b"\xff"))], "path string, content binary")
    got = sorted((r["path"], r["page_number"], r["text"]) for r in S.extract_lines(files).collect() if r["text"] is not None)
    assert got == [("good", 1, "a"), ("good", 1, "b"), ("good", 2, "c")]
    assert S.extract_lines(files).filter("text is null").count() == 1


def test_uploads(spark):
    df = spark.createDataFrame([(bytearray(b"%PDF-1.4"), "../../etc/My Bylaw (1).PDF"), (bytearray(b"MZ"), "..")], "c binary, n string")
    assert [tuple(r[0]) for r in df.select(S.acceptable_upload(F.col("c"), F.col("n"))).collect()] == [(True, "my-bylaw-1.pdf"), (False, "document.pdf")]


def test_ocr_replaces_only_what_is_poor_and_worse(spark):
    pages = spark.createDataFrame([(1, 1, "x", 0.2), (1, 2, "fine", 0.9), (1, 3, "y", 0.1)], "document_id int, page_number int, text string, confidence double")
    ocr = spark.createDataFrame([(1, 1, "read", 0.95), (1, 2, "other", 0.99)], "document_id int, page_number int, text string, confidence double")
    got = [tuple(r) for r in S.prefer_ocr(pages, ocr).orderBy("page_number").collect()]
    assert got == [(1, 1, "read", 0.75, True, False), (1, 2, "fine", 0.9, False, False), (1, 3, "y", 0.1, False, True)]


def test_suite_round_trip(spark, tmp_path):
    suite = {"name": "s", "cases": [{"id": "1", "question": "q", "kind": "fact", "expected_municipalities": ["surrey"], "verified_by": "me"}, {"id": "2", "question": "r", "kind": "ambiguity"}]}
    (tmp_path / "suite.json").write_text(json.dumps(suite, indent=1))
    cases = S.read_suite(spark, str(tmp_path / "suite.json"))
    assert cases.count() == 2 and S.verified(cases).count() == 1 and S.by_kind(cases, "ambiguity").count() == 1 and S.by_municipality(cases, "surrey").count() == 1
    S.write_suite(cases, str(tmp_path / "out"))
    assert S.read_suite(spark, str(tmp_path / "out")).count() == 2


CONFIG = {"dataset": "d", "address_field": "addr", "zone_field": "zone"}


def test_connectors(spark, tmp_path):
    import zoning_fixture as Z0

    spark.sparkContext.addPyFile(Z0.__file__)
    at = {k: f"{tmp_path}/{k}/__" for k in ("arcgis", "opendatasoft", "socrata", "down", "points", "bare")}
    by_point = {"dataset": "d", "zone_field": "zone"}
    made = [("surrey", "arcgis", CONFIG | {"endpoint": at["arcgis"]}, True), ("hope", "opendatasoft", CONFIG | {"endpoint": at["opendatasoft"]}, True), ("delta", "socrata", CONFIG | {"endpoint": at["socrata"]}, True)]
    made += [("down", "arcgis", CONFIG | {"endpoint": at["down"]}, True), ("unverified", "arcgis", CONFIG | {"endpoint": at["arcgis"]}, False), ("points", "opendatasoft", by_point | {"endpoint": at["points"]}, True), ("half", "arcgis", {"endpoint": "e"}, True)]
    providers = spark.createDataFrame(made, "municipality_slug string, kind string, config map<string,string>, verified boolean")
    cities = [m[0] for m in made] + ["nowhere"]
    asked = spark.createDataFrame([(c, a) for c in cities for a in ("1 main st", "5 main st", "91 o'neil av", "90 o'neil av", "77 main st", None)], "municipality_slug string, normalized_address string")
    for k in at:
        (tmp_path / k).touch()

    def locate(address):
        return (0.0, 0.0) if address.startswith("1 ") else None

    got = {(r[0], r[1]): (r[2], r[3]) for r in Z.lookup(asked, providers, Z0.serve, locate).filter("zone is not null").collect()}
    assert got == {(c, a): (z, 1.0) for c in ("surrey", "hope", "delta") for a, z in (("1 main st", "C-1"), ("91 o'neil av", "A-1"))} | {("points", "1 main st"): ("C-1", 0.85)}
    assert Z.lookup(asked, providers).filter("zone is not null").count() == 0
    assert Z.build("nothing", {}) is None and Z.zone_of("opendatasoft", by_point | {"endpoint": at["bare"]}, "1 main st", Z0.serve) is None
    spark.dataSource.register(Z.StaticZoning)
    assert [tuple(r) for r in spark.read.format("static_zoning").option("surrey|1 main st", "C-1").load().collect()] == [("surrey", "1 main st", "C-1")]


def test_records_of_services_page_by_page(spark, tmp_path):
    import zoning_fixture as Z0

    spark.sparkContext.addPyFile(Z0.__file__)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Z.ZoningRecords)
    providers = [{"municipality_slug": k, "kind": k, "config": CONFIG | {"endpoint": f"{tmp_path}/{k}/__"}} for k in ("arcgis", "opendatasoft", "socrata")]

    def load():
        return spark.read.format("zoning_records").options(providers=json.dumps(providers), fetch="zoning_fixture:serve", page_rows="10").load()

    def sent(k):
        log = tmp_path / f"{k}.log"
        return log.read_text().splitlines() if log.exists() else []

    everything = load().collect()
    assert sorted(tuple(r)[1:] for r in everything if r[0] == "socrata") == sorted((a, z or None) for a, z in Z0.PARCELS)
    assert len(everything) == 3 * len(Z0.PARCELS) and [len(sent(k)) for k in ("arcgis", "opendatasoft", "socrata")] == [3, 3, 3]
    one = load().filter("municipality_slug = 'arcgis' and address = '5 MAIN ST'").collect()
    assert sorted(r["zone"] for r in one) == ["C-5", "R-1"]
    assert [len(sent(k)) for k in ("arcgis", "opendatasoft", "socrata")] == [4, 3, 3] and "5 MAIN ST" in sent("arcgis")[-1]


def test_stream_ingests_each_content_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.pdf").write_bytes(b"one")
    stored = []

    def store(rows):
        stored.extend(r["path"].rsplit("/", 1)[1] for r in rows.collect())

    def go():
        I.ingest(I.new_files(spark, str(source)), str(tmp_path / "known"), str(tmp_path / "state"), store).awaitTermination()

    go()
    (source / "b.pdf").write_bytes(b"two")
    (source / "c.pdf").write_bytes(b"one")
    go()
    go()
    assert sorted(stored) == ["a.pdf", "b.pdf"]


def test_report(spark):
    checks = spark.createDataFrame([("a", 1.0, True, True), ("b", 0.5, False, True), ("c", 0.5, False, False)], "name string, value double, passed boolean, blocking boolean")
    text = S.markdown_report(checks, "Report")
    assert "| b | 0.5 | FAIL |" in text and "| c | 0.5 | warn |" in text


def test_ocr_probe_says_why(tmp_path):
    from docketspark.sources.files import probe_ocr

    assert probe_ocr("no-such-program") == {"available": False, "path": None, "languages": [], "reason": "no-such-program is not installed"}
    for code, out in ((0, "eng"), (0, "deu"), (3, "eng")):
        program = tmp_path / f"ocr{code}{out}"
        program.write_text(f"#!/bin/sh\necho {out}\nexit {code}\n")
        program.chmod(0o755)
        found = probe_ocr(str(program))
        assert found["available"] == (code == 0 and out == "eng") and (found["reason"] is None) == found["available"]
