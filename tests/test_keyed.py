"""Tables with keyed writes: what changes, what is rewritten, what a broken or late write leaves."""

import pytest
from pyspark.sql import functions as F

from docketspark.sources.keyed import Conflict, KeyedTable, delete_cascade


def listed(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture()
def made(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"v{i}", i % 2 == 0) for i in range(200)] + [(None, "none", False)], "id long, v string, verified boolean")
    t = KeyedTable(spark, str(tmp_path / "t"), ["id"], 16)
    t.create(rows)
    return t, rows


def test_writes_touch_their_buckets_alone(spark, made):
    t, rows = made
    assert listed(t.read()) == listed(rows)
    before = t.manifest()["folders"]
    t.upsert(spark.createDataFrame([(7, "late", True), (7, "early", True), (900, "new", True)], "id long, v string, verified boolean"), F.when(F.col("v") == "late", 1).otherwise(0))
    after = t.manifest()["folders"]
    changed = {b for b in after if before.get(b) != after[b]}
    assert len(changed) <= 2 and t.rewritten[-1][0] == len(changed) and t.rewritten[-1][1] < 0.4 * t.rewritten[0][1]
    assert listed(t.lookup(7)) == [(7, "late", True)] and listed(t.lookup(900)) == [(900, "new", True)] and t.lookup(901).count() == 0
    assert t.read().count() == 202 and listed(t.read(1)) == listed(rows)
    t.insert_ignore(spark.createDataFrame([(7, "ignored", True), (901, "x", False), (901, "x", False)], "id long, v string, verified boolean"))
    assert listed(t.lookup(7)) == [(7, "late", True)] and t.read().count() == 203
    t.guarded_update(spark.createDataFrame([(8, "no"), (9, "yes"), (11, None)], "id long, v string"), ["v"], "verified")
    assert [t.lookup(i).first()["v"] for i in (8, 9, 11)] == ["v8", "yes", "v11"]
    version = t.versions()[-1]
    t.upsert(rows.limit(0), F.lit(0))
    assert t.versions()[-1] == version


def test_a_broken_write_leaves_the_table(spark, made):
    t, rows = made
    bad = spark.createDataFrame([(1, "x", True)], "id long, v string, verified boolean").withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        t.upsert(bad, F.lit(0))
    assert listed(t.read()) == listed(rows) and t.versions() == [1]


def test_of_two_writes_at_once_the_second_fails(spark, made):
    t, rows = made
    other = KeyedTable(spark, t.path, ["id"])
    change = spark.createDataFrame([(1, "mine", True)], "id long, v string, verified boolean")
    read = other.manifest
    first = read()
    t.upsert(change, F.lit(0))
    other.manifest = lambda version=None: first  # it has read before the other one wrote
    with pytest.raises(Conflict):
        other.upsert(change.withColumn("v", F.lit("theirs")), F.lit(0))
    assert listed(t.lookup(1)) == [(1, "mine", True)]


def test_cascades_and_expiry(spark, made, tmp_path):
    t, rows = made
    child = KeyedTable(spark, str(tmp_path / "c"), ["id"], 16)
    child.create(rows.filter("id is not null").select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")))
    delete_cascade(spark.createDataFrame([(3,), (4,), (5000,)], "id long"), t, [child])
    assert t.read().count() == 199 and child.read().count() == 396 and child.lookup(3).count() == 0
    delete_cascade(t.read().select("id").filter("id is not null"), t, [child])
    assert listed(t.read()) == [(None, "none", False)] and child.read().count() == 0
    child.upsert(spark.createDataFrame([(1, 1)], "id long, k int"), F.lit(0))
    assert listed(child.read()) == [(1, 1)]
    assert t.expire(1) > 0 and listed(t.read()) == [(None, "none", False)] and t.versions() == [3]
