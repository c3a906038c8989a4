"""The stored indexes of postings and vectors against brute force, on edge cases, and across changes of the data."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docketspark.functions import varint as VI
from docketspark.functions import words as WD
from docketspark.functions.stem import english_stem
from docketspark.operators import fulltext
from docketspark.operators import retrieval as V
from docketspark.operators.ann import VectorIndex
from docketspark.operators.postings import TermIndex, cover_score, english
from docketspark.session import ship

TEXTS = [None, "", "...", "Signs signed, cities of the city", "city of nothing", "É sign", "the sign of the sign", "a1 b2 a1"]


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="module")
def made():
    rng = random.Random(5)
    return [(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 14)))) for i in range(120)] + [(200, None), (201, "")]


def test_english_stems():
    # fixed values: published examples of the algorithm
    expected = {
        "consigned": "consign", "consistency": "consist", "consolations": "consol", "consolatory": "consolatori", "consolidating": "consolid", "conspicuously": "conspicu", "conspirators": "conspir", "knackeries": "knackeri",
        "knavish": "knavish", "kneeling": "kneel", "knightly": "knight", "knives": "knive", "hopping": "hop", "hoping": "hope", "ties": "tie", "cries": "cri", "gas": "gas", "this": "this", "gaps": "gap", "generates": "generat", "communism": "communism",
        "arsenal": "arsenal", "dying": "die", "skies": "sky", "news": "news", "succeeding": "succeed", "innings": "inning", "sayings": "say", "youth": "youth", "rational": "ration", "controll": "control", "roll": "roll", "rate": "rate",
    }
    assert {w: english_stem(w) for w in expected} == expected
    assert [english_stem(w) for w in ("", "a", "x9", "abc1", "é")] == ["", "a", "x9", "abc1", "é"]
    assert english("the") is None and english("signs") == "sign"


def test_occurrences_of_long_texts_are_those_of_short_ones(monkeypatch):
    texts = pa.array(["ab cd  ab,x1 " * 40 + "y" * 300, "one", "", "ab " * 90])

    def listed():
        out = {}
        for first, found in WD.occurrences(texts):
            lists = found.positions().to_pylist()
            for k, (doc, term) in enumerate(zip(found.doc.tolist(), found.term().to_pylist(), strict=True)):
                out[first + doc, term] = (lists[k], int(found.sizes[doc]))
        return out

    whole = listed()
    assert whole[0, "x1"] == ([3 + 4 * k for k in range(40)], 161) and whole[1, "one"] == ([0], 1)
    monkeypatch.setattr(WD, "SLICE_BYTES", 100)
    monkeypatch.setattr(WD.slices, "__defaults__", (100,))
    assert listed() == whole


def test_numbers_are_packed_and_come_back():
    rng = np.random.default_rng(6)
    counts = np.array([3, 0, 1, 500, 0, 2])
    values = np.concatenate([rng.integers(0, 200, 400), rng.integers(0, 2**62, 103), [0, 127, 128]])
    packed = VI.pack(values, counts)
    assert VI.unpack(packed).tolist() == values.tolist() and [len(VI.unpack(packed[i : i + 1])) for i in range(6)] == counts.tolist()
    assert VI.unpack(VI.pack(values[:0], counts[:0])).tolist() == []
    signed = np.array([0, -1, 1, -(2**62), 2**62, -5])
    assert VI.unzigzag(VI.unpack(VI.pack(VI.zigzag(signed), np.array([6])))).tolist() == signed.tolist()
    rising = np.sort(rng.integers(-1000, 1000, 506))
    assert VI.sums(VI.deltas(rising, counts), counts).tolist() == rising.tolist()


def test_index_with_stems_and_stop_words(spark):
    docs = spark.createDataFrame([*enumerate(TEXTS), (None, "sign"), (-(2**60), "zz"), (2**60, "zz zz")], "id long, text string")
    index = TermIndex(docs, ("stems",), term_of=english)
    assert {r["term"] for r in index.postings.collect()} == {"sign", "citi", "noth", "a1", "b2", "zz"}
    asked = spark.createDataFrame([(1, "sign"), (2, "cities"), (3, "the"), (4, "none")], "query_id long, term string")
    assert {(r["query_id"], r["id"]) for r in index.search(asked, 5).collect()} == {(1, 3), (1, 5), (1, 6), (2, 3), (2, 4)}
    assert {(r["query_id"], r["id"]) for r in index.search(asked, 5, docs.filter("id = 4")).collect()} == {(2, 4)}
    assert {(r["query_id"], r["id"]) for r in index.match([(1, "signs -city"), (2, '"sign of the signs"'), (3, "the"), (4, "nothing OR b2"), (5, "-sign")]).collect()} == {(1, 5), (1, 6), (4, 4), (4, 7), *((5, i) for i in (0, 1, 2, 4, 7, -(2**60), 2**60)), (2, 6)}
    assert {(r["id"], r["tf"], r["size"]) for r in index.postings.filter("term = 'zz'").collect()} == {(-(2**60), 1, 1), (2**60, 2, 2)}
    assert TermIndex(docs.limit(0), ("no rows",)).search(asked, 5).count() == 0


def test_cover_density_against_brute_force(spark, made):
    index = TermIndex(spark.createDataFrame(made, "id long, text string").repartition(3), ("covers",), file_bytes=100)
    assert index.buckets > 3
    asked = {1: "ab", 2: "abc", 3: "a", 4: "dax"}
    given = spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts], "query_id long, term string")
    got = {(r["query_id"], r["id"]): r["score"] for r in index.cover_density(given, 1000).collect()}
    for (q, terms), (i, text) in itertools.product(asked.items(), made):
        ts = (text or "").split()
        covers = [(p, e) for p in range(len(ts)) for e in range(p, len(ts)) if set(terms) <= set(ts[p : e + 1])]
        least = [c for c in covers if not any(d != c and c[0] <= d[0] and d[1] <= c[1] for d in covers)]
        assert got.get((q, i), 0.0) == pytest.approx(sum(1 / (1 + sum(t not in terms for t in ts[p : e + 1])) for p, e in least))
    assert cover_score([np.array([0]), np.array([3, 9]), np.array([5])]) == pytest.approx(1 / 4)


def test_web_queries_from_the_index_are_those_of_a_scan(spark, made):
    docs = spark.createDataFrame(made, "id long, text string")
    index = TermIndex(docs, ("web",), file_bytes=100)
    queries = ['"a b"', '"a b c" OR "d d"', "a b -c", "-a", '-"a b" -d', "a a", '"a a" -b', "x OR a", "-x", "", "-", "OR", '"a b" "b a"', "b -b"]
    scanned = {(q, r[0]) for q, text in enumerate(queries) for r in docs.filter(fulltext.matches(F.col("text"), text)).select("id").collect()}
    assert {(r["query_id"], r["id"]) for r in index.match(list(enumerate(queries))).collect()} == scanned
    few = docs.filter("id < 30")
    assert {(r["query_id"], r["id"]) for r in index.match(list(enumerate(queries)), few).collect()} == {(q, i) for q, i in scanned if i < 30}


def test_few_terms_read_their_buckets_alone(spark, made):
    index = TermIndex(spark.createDataFrame(made, "id long, text string"), ("pruned",), file_bytes=100)
    plan = index.of_terms(spark.createDataFrame([("a",)], "term string"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and "In(term" in plan or "EqualTo(term" in plan


def test_an_index_follows_its_data(spark, tmp_path):
    at, where = str(tmp_path / "docs"), str(tmp_path / "index")
    one = spark.createDataFrame([(1, "first")], "id long, text string")
    one.write.parquet(at)
    asked = spark.createDataFrame([(1, "first"), (2, "second")], "query_id long, term string")

    def found():
        return {(r["query_id"], r["id"]) for r in TermIndex(spark.read.parquet(at), ("docs", at), path=where).search(asked, 5).collect()}

    assert found() == {(1, 1)} == found()
    before = sorted(p.name for p in (tmp_path / "index").iterdir())
    one.select((F.col("id") + 1).alias("id"), F.lit("second").alias("text")).write.mode("append").parquet(at)
    assert found() == {(1, 1), (2, 2)}
    assert set(before) < {p.name for p in (tmp_path / "index").iterdir()}


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_vector_index_recall(spark, sf):
    """At least nine in ten of the true neighbours, with exact scores of at most a tenth of the pairs."""
    vectors = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").withColumnRenamed("vec_id", "id").select("id", "embedding")
    asked = vectors.filter("id % 20 = 0")
    exact = {(r["query_id"], r["id"]): r["score"] for r in V.knn(vectors, asked, 10, 64).collect()}
    index = VectorIndex(vectors, 64, ("recall", sf))
    found = {(r["query_id"], r["id"]): r["score"] for r in index.search(asked, 10).collect()}
    both = set(exact) & set(found)
    assert len(both) >= 0.9 * len(exact) and len(found) == len(exact) and 40 <= 0.1 * vectors.count()
    assert all(abs(exact[k] - found[k]) < 1e-12 for k in both)


def test_lists_follow_clusters_and_rows(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    data = [(i, (centres[i % 40] + 0.1 * rng.normal(size=16)).tolist()) for i in range(1600)] + [(5000, [0.0] * 16), (5001, None), (5002, [1.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(data, "id long, embedding array<double>").repartition(4)
    index = VectorIndex(df, 16, ("clusters",))
    assert index.probes < 0.2 * len(index.book.lists)  # near rows share a list
    less = VectorIndex(df.filter("id < 200"), 16, ("fewer",))
    assert len(less.book.lists) < len(index.book.lists)
    asked = df.filter("id < 40")
    exact = {(r["query_id"], r["id"]) for r in V.knn(df.filter("id < 1600"), asked, 10, 16).collect()}
    got = {(r["query_id"], r["id"]) for r in index.search(asked, 10).collect()}
    assert len(exact & got) >= 0.9 * len(exact)
    assert VectorIndex(df.limit(0), 16, ("none",)).search(asked, 3).count() == 0
    assert index.search(asked.limit(0), 3).count() == 0


def test_distances_are_measured_exactly_in_several_passes(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(150, 4)) * 1000
    data[7] = data[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, embedding array<double>").repartition(3)
    got = sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in V.knn(df, df.filter("id < 9"), 4, 4, metric="l2", block=2).collect())
    expected = []
    for q in range(9):
        d = np.sqrt(((data - data[q]) ** 2).sum(1))
        expected += [(q, k + 1, int(i), -d[i]) for k, i in enumerate(sorted(range(150), key=lambda i: (d[i], i))[:4])]
    assert [x[:3] for x in got] == [x[:3] for x in expected] and np.allclose([x[3] for x in got], [x[3] for x in expected], rtol=1e-12, atol=0)
