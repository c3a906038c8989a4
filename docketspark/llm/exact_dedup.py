"""Exact dedup by progressive refinement: length, then prefix hash, then full hash of the surviving groups only.

Three scans of the texts and no shuffle of them. The first finds, with partial aggregation, the lengths that occur more than once;
they become a bitmap sized by their number, of 8 MB at most. The second hashes the prefixes of the texts that it lets pass, and the
pairs of length and prefix that occur more than once become the next bitmap. The third computes the full SHA-256 where both let
a row pass; all other rows are known to be alone. What is shuffled are narrow rows: id, length, two hashes. A hot group is aggregated map-side, and the join back to its rows is one whose
skewed partitions adaptive execution splits.

Defined cases: a null text equals the empty text; of rows that repeat the same id and text one stays; a null id never
wins over another id; texts of any length are hashed whole, as a stream; rows of one id with different texts are different
documents; an empty table gives an empty result; extra columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketspark.llm.common import bitmap, bits_for, in_bitmap
from docketspark.session import cut

PREFIX_CHARS = 256


def refine(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, digest_all: bool = False) -> DataFrame:
    """Narrow rows (id, n_bytes, prefix, survives, full): ``prefix`` is null where the length, and ``full`` where length and prefix,
    already tell a text from all others.

    ``digest_all`` also fills ``full`` for the rows that are alone, for callers that report it.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    length = F.octet_length(body).cast("long")
    of_length = F.xxhash64("n_bytes")
    lengths = cut(docs.select(length.alias("n_bytes")).groupBy("n_bytes").agg(F.count("*").alias("n")).filter("n > 1").select("n_bytes"), "lengths")
    log2_lengths = bits_for(lengths.count())
    # each stage reads of a text what the one before left in doubt: its length, its prefix, all of it
    shared = docs.select(F.col(id_col).alias("id"), length.alias("n_bytes"), body.alias("body")).withColumn("shared", in_bitmap(bitmap(lengths, of_length, log2_lengths).scalar(), of_length, log2_lengths))
    rows = shared.withColumn("prefix", F.when(F.col("shared"), F.xxhash64(F.substring("body", 1, prefix_chars))))
    key = F.xxhash64("n_bytes", "prefix")
    repeated = cut(rows.filter("shared").groupBy("n_bytes", "prefix").agg(F.count("*").alias("n")).filter("n > 1").select("n_bytes", "prefix"), "shapes")
    log2_bits = bits_for(repeated.count())
    survives: Column = F.col("shared") & in_bitmap(bitmap(repeated, key, log2_bits).scalar(), key, log2_bits)
    full = F.sha2("body", 256)
    return rows.withColumn("survives", survives).select("id", "n_bytes", "prefix", "survives", (full if digest_all else F.when(F.col("survives"), full)).alias("full"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, full (SHA-256; null where no hash was needed, unless ``digest_all``).

    Rows that repeat the id and the text that stay are all marked ``kept``; ``drop_copies`` leaves one of them.
    """
    rows = cut(refine(docs, id_col, text_col, digest_all=digest_all), "exact-dedup")
    groups = (
        rows.filter("survives")
        .groupBy("n_bytes", "prefix", "full")
        .agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
        .filter("group_size > 1")
        .withColumnRenamed("full", "full_key")
    )
    # written first: a join right above an aggregate is one whose hot partitions adaptive execution does not split
    groups = cut(groups, "groups")
    joined = rows.alias("r").join(
        groups.alias("g"),
        (F.col("r.n_bytes") == F.col("g.n_bytes")) & (F.col("r.prefix") == F.col("g.prefix")) & (F.when(F.col("r.survives"), F.col("r.full")) == F.col("g.full_key")),
        "left",
    )
    return joined.select(
        "id",
        F.when(F.col("g.full_key").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.expr("1L")).alias("group_size"),
        "full",
    ).withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the copies: of equal texts one row stays, with the largest id. All columns stay.

    Only rows that a bitmap of the groups' ids lets pass are shuffled for the exact answer. Of rows with equal id and
    text one stays, whichever: their other columns do not decide.
    """
    found = cut(exact_dedup(docs, id_col, text_col).filter("group_size > 1").select("id", "keep_id", "full"), "copies")
    log2_bits = bits_for(found.count())
    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    maybe = in_bitmap(bitmap(found, F.xxhash64("id"), log2_bits).scalar(), F.xxhash64("id"), log2_bits)
    alone = packed.filter(~maybe).select("row.*")
    suspects = packed.filter(maybe).select("row", "id", F.sha2("body", 256).alias("full"))
    dropped = found.filter(~F.col("id").eqNullSafe(F.col("keep_id"))).select(F.col("id").alias("gone_id"), F.col("full").alias("gone_full")).distinct()
    left = suspects.join(dropped, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("full") == F.col("gone_full")), "left_anti")
    return alone.unionByName(left.dropDuplicates(["id", "full"]).select("row.*"))
