"""Answers: context assembly, confidence from six factors, outcomes and conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# fixed values: weights of the factors and lower bounds of the bands
WEIGHTS = {"citation": 0.30, "currency": 0.20, "corroboration": 0.20, "margin": 0.10, "source": 0.10, "specificity": 0.10}
BANDS = (("high", 0.75), ("medium", 0.50), ("low", 0.25))


def context_blocks(retrieved: DataFrame, by: str = "question_id", order: str = "rank") -> DataFrame:
    """Per question the numbered excerpts, ``[S1] ...``, with the chunk each number stands for. Ranks are few: the top of a pool."""
    n = F.row_number().over(W.partitionBy(by).orderBy(order))
    header = F.concat_ws(" | ", "document_title", F.concat(F.lit("s. "), "section_number"), F.concat(F.lit("p. "), F.col("page_number").cast("string")))
    rows = retrieved.withColumn("source_id", n).withColumn("block", F.concat(F.lit("[S"), n.cast("string"), F.lit("] "), header, F.lit("\n"), F.col("body")))
    joined = F.transform(F.array_sort(F.collect_list(F.struct("source_id", "chunk_id", "block"))), lambda x: x)
    return rows.groupBy(by).agg(joined.alias("s")).select(by, F.array_join(F.transform("s", lambda x: x["block"]), "\n\n").alias("context"), F.transform("s", lambda x: F.struct(x["source_id"].alias("source_id"), x["chunk_id"].alias("chunk_id"))).alias("source_map"))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def confidence(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """Raw sum, score and band of each answer.

    ``chunks``: answer_id, document_id, section_number, municipality_slug, status, final_score, from_ocr, extraction_confidence, cited.
    ``answers``: answer_id, precision, n_cited, n_uncited, abstained, conflict.
    """
    cited, has = F.col("cited"), F.max(F.col("cited").cast("int"))

    def among(condition: Column) -> Column:
        return F.when(has == 1, F.count_if(condition & cited)).otherwise(F.count_if(condition))

    whole = F.when(has == 1, F.count_if(cited)).otherwise(F.count("*"))
    best, n = F.max("final_score"), F.count("*")
    rest = (F.sum("final_score") - best) / (n - 1)
    used = F.when(has == 1, F.avg(F.when(cited, F.coalesce("extraction_confidence", F.lit(0.0))))).otherwise(F.avg(F.coalesce("extraction_confidence", F.lit(0.0))))
    places = F.count_distinct(F.when(cited, F.struct("document_id", "section_number")))
    g = chunks.groupBy("answer_id").agg(
        F.least(F.lit(1.0), _share(among(F.col("status") == "in_force"), whole) + 0.4 * _share(among(F.col("status") == "unknown"), whole)).alias("currency"),
        F.when(places == 0, 0.2).when(places == 1, 0.6).when(places == 2, 0.85).otherwise(1.0).alias("spread"),
        F.when(n < 2, 0.5).when(best <= 0, 0.2).otherwise(F.least(F.lit(1.0), 3 * F.greatest(F.lit(0.0), (best - rest) / F.abs(best)))).alias("margin"),
        F.greatest(F.lit(0.0), used - 0.35 * _share(among(F.col("from_ocr")), whole)).alias("source"),
        (0.5 * F.max((F.coalesce("municipality_slug", F.lit("")) != "").cast("int")) + 0.5 * F.max((cited & (F.coalesce("section_number", F.lit("")) != "")).cast("int"))).alias("specificity"),
        F.bool_or(cited & (F.col("status") != "in_force")).alias("cites_stale"),
        n.alias("n_chunks"),
    )
    rows = answers.join(g, "answer_id", "left")
    citation = F.when(F.col("n_cited") == 0, 0.0).otherwise(F.col("precision") * F.when(F.col("n_uncited") > 0, F.greatest(F.lit(0.3), 1 - 0.25 * F.col("n_uncited"))).otherwise(1.0))
    factors = {
        "citation": F.bround(citation, 3),
        "currency": F.bround("currency", 3),
        "corroboration": F.when(F.col("conflict"), 0.25).otherwise(F.col("spread")),
        "margin": F.bround("margin", 3),
        "source": F.bround("source", 3),
        "specificity": F.col("specificity"),
    }
    # factors are thousandths and weights are tenths, so the sum is exact in ten-thousandths and its rounding has no accidents
    total = F.lit(0)
    for name, weight in WEIGHTS.items():
        total = total + round(10 * weight) * F.round(factors[name] * 1000).cast("int")
    nothing = F.col("abstained") | F.col("n_chunks").isNull()
    score = F.when(nothing, 0.0).otherwise(F.bround(F.least(F.lit(10_000), F.greatest(F.lit(0), total)) / 10.0, 0) / 1000)
    return rows.select("answer_id", F.when(nothing, 0.0).otherwise(total / 10_000).alias("raw"), score.alias("score"), band(score, F.coalesce("cites_stale", F.lit(False))).alias("band"))


def band(score: Column, capped: Column) -> Column:
    """Band of a score; a capped one is low at best."""
    return F.when(~capped & (score >= BANDS[0][1]), "high").when(~capped & (score >= BANDS[1][1]), "medium").when(score >= BANDS[2][1], "low").otherwise("insufficient")


def outcome() -> Column:
    """The first that fits, over boolean columns of a question's run."""
    return (
        F.when(F.col("out_of_scope"), "out_of_scope")
        .when(F.col("ambiguous"), "needs_clarification")
        .when(~F.col("index_ready"), "index_not_ready")
        .when(F.col("retrieval_failed"), "no_relevant")
        .when((F.col("n_chunks") == 0) & (F.col("n_outdated") > 0), "only_outdated")
        .when(F.col("n_chunks") == 0, "no_relevant")
        .when(F.col("conflict"), "conflicting_amendments")
        .when(~F.col("generated"), "generation_unavailable")
        .when(F.col("abstained"), "unverified")
        .otherwise("answered")
    )
