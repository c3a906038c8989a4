"""Which document versions are in force: a corpus-wide lineage of amendments, repeals and consolidations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketspark.functions.text import bylaw_key

REPEALED, UNKNOWN, SUPERSEDED, IN_FORCE = "repealed", "unknown", "superseded", "in_force"


def version_date(consolidation: Column, effective: Column, year: Column) -> Column:
    return F.coalesce(consolidation, effective, F.make_date(year, F.lit(1), F.lit(1)))


def prepare(facts: DataFrame) -> DataFrame:
    """Facts (document_id, municipality_slug, bylaw_number, doc_type, consolidation_date, effective_date, year, amends, repeals)
    with key, version date and the order of versions: undated first, then by date, consolidations last, then by id."""
    dated = facts.withColumn("key", bylaw_key(F.col("bylaw_number"))).withColumn("version_date", version_date(F.col("consolidation_date"), F.col("effective_date"), F.col("year")))
    return dated.withColumn("order", F.struct(F.col("version_date").isNotNull().alias("dated"), F.coalesce("version_date", F.lit("1000-01-01").cast("date")).alias("on"), (F.col("doc_type") == "consolidated").alias("whole"), F.col("document_id").alias("id")))


def edges(facts: DataFrame) -> DataFrame:
    """parent, child, relation_type, confidence: what a document amends or repeals, and what the newest version replaces.

    References are joined on (municipality, number), so never across cities and never to the document itself.
    """
    p = prepare(facts)
    named = [
        p.select(F.col("document_id").alias("child"), "municipality_slug", F.explode(column).alias("number")).select("child", "municipality_slug", bylaw_key(F.col("number")).alias("key"), F.lit(kind).alias("relation_type"))
        for column, kind in (("amends", "amends"), ("repeals", "repeals"))
    ]
    targets = p.filter("key is not null").select("municipality_slug", "key", F.col("document_id").alias("parent"))
    hits = named[0].unionByName(named[1]).distinct().join(targets, ["municipality_slug", "key"]).filter("parent <> child")
    n = F.count("*").over(W.partitionBy("child", "municipality_slug", "key", "relation_type"))
    references = hits.select("parent", "child", "relation_type", F.when(n == 1, 0.85).otherwise(0.4).alias("confidence"))
    keyed = p.filter("key is not null and municipality_slug is not null")
    newest = keyed.groupBy("municipality_slug", "key").agg(F.max_by(F.struct("document_id", "doc_type"), "order").alias("new"), F.count("*").alias("n")).filter("n > 1")
    older = keyed.join(newest, ["municipality_slug", "key"]).filter(F.col("document_id") != F.col("new.document_id"))
    versions = older.select(F.col("document_id").alias("parent"), F.col("new.document_id").alias("child"), F.when(F.col("new.doc_type") == "consolidated", "consolidates").otherwise("replaces").alias("relation_type"), F.lit(0.75).alias("confidence"))
    return references.unionByName(versions)


def resolve(facts: DataFrame) -> DataFrame:
    """document_id, status, last_amendment_date, needs_review. The first rule that fits decides."""
    p = prepare(facts)
    refs = edges(facts)
    repealed = refs.filter("relation_type = 'repeals'").select(F.col("parent").alias("document_id")).distinct().withColumn("is_repealed", F.lit(True))
    newest = p.filter("key is not null and municipality_slug is not null").groupBy("municipality_slug", "key").agg(F.max_by("document_id", "order").alias("newest"))
    # an amendment is absorbed by a consolidation of what it amends, dated no earlier
    amends = refs.filter("relation_type = 'amends'")
    own = p.select(F.col("document_id").alias("child"), F.col("version_date").alias("own_date"))
    whole = p.filter("doc_type = 'consolidated' and consolidation_date is not null").select(F.col("document_id").alias("parent"), "consolidation_date")
    absorbed = amends.join(own, "child").join(whole, "parent").filter("consolidation_date >= own_date").select(F.col("child").alias("document_id")).distinct().withColumn("is_absorbed", F.lit(True))
    amended = amends.join(own, "child").groupBy(F.col("parent").alias("document_id")).agg(F.max("own_date").alias("last_amendment_date"))
    rows = p.join(repealed, "document_id", "left").join(newest, ["municipality_slug", "key"], "left").join(absorbed, "document_id", "left").join(amended, "document_id", "left")
    no_key = F.col("key").isNull() | F.col("municipality_slug").isNull()
    undated, amendment = F.col("version_date").isNull(), F.col("doc_type") == "amendment"
    status = (
        F.when(F.col("is_repealed"), REPEALED)
        .when(no_key, UNKNOWN)
        .when(F.col("newest") != F.col("document_id"), SUPERSEDED)
        .when(undated, UNKNOWN)
        .when(amendment & F.coalesce("is_absorbed", F.lit(False)), SUPERSEDED)
        .otherwise(IN_FORCE)
    )
    return rows.select("document_id", status.alias("status"), "last_amendment_date").withColumn("needs_review", F.col("status") == UNKNOWN)


def apply_status(documents: DataFrame, resolved: DataFrame) -> DataFrame:
    """Documents with the resolved status, but for those that a person verified."""
    new = resolved.select("document_id", F.col("status").alias("_new"), F.col("last_amendment_date").alias("_last"))
    joined = documents.join(new, "document_id", "left")
    return joined.withColumn("status", F.when(F.col("verified_by_human"), F.col("status")).otherwise(F.coalesce("_new", "status"))).withColumn("last_amendment_date", F.coalesce("_last", "last_amendment_date")).drop("_new", "_last")
