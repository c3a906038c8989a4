"""Evaluation: cases scored, suites, calibration, validation reports and their thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketspark.operators.relational import nearest_rank

# fixed values: acceptance thresholds
THRESHOLDS = {
    "ingestion_success_rate": 1.0,
    "documents_without_sections": 0,
    "errors": 0,
    "stale_citations": 0,
    "citation_verification_rate": 0.95,
    "answers_with_citations": 0.90,
    "retrieval_precision": 0.90,
    "correct_abstention_rate": 0.90,
    "false_abstention_rate": 0.20,
    "behaviour_accuracy": 0.90,
    "retrieval_p95_ms": 2000,
    "answer_p95_ms": 30000,
    "embedding_throughput": 5.0,
}
AT_MOST = {"documents_without_sections", "errors", "stale_citations", "false_abstention_rate", "retrieval_p95_ms", "answer_p95_ms"}
NOT_BLOCKING = {"retrieval_p95_ms", "answer_p95_ms", "embedding_throughput"}


def rate(hit: Column, of: Column | None = None) -> Column:
    """Share of rows that satisfy ``hit``, among those that satisfy ``of``; 0 where there is none."""
    of = F.lit(True) if of is None else of
    n = F.count_if(of)
    return F.when(n > 0, F.count_if(of & hit) / n).otherwise(0.0)


def score_cases(cases: DataFrame) -> DataFrame:
    """Golden cases with their answers: found_rank, retrieval_ok, passed.

    ``cases``: kind, acceptable array, retrieved array (by rank), precision, n_stale, error, behaved, has_expected, has_forbidden.
    """
    first = F.array_min(F.filter(F.transform("acceptable", lambda a: F.nullif(F.array_position("retrieved", a), F.lit(0).cast("long"))), lambda p: p.isNotNull()))
    any_ok = F.size("acceptable") == 0
    rows = cases.withColumn("found_rank", first).withColumn("retrieval_ok", any_ok | first.isNotNull())
    behavioural = F.col("kind").isin("ambiguity", "out_of_scope", "abstention")
    passed = F.when((F.coalesce("error", F.lit("")) != "") | (F.col("n_stale") > 0) | ~F.col("behaved") | F.col("has_forbidden"), False).when(behavioural, True).otherwise(F.col("retrieval_ok") & (F.col("precision") >= 0.5) & F.col("has_expected"))
    return rows.withColumn("passed", passed)


def case_flags(cases: DataFrame) -> DataFrame:
    """What an answer did, from the answer itself: has_expected, has_forbidden, behaved.

    ``cases``: answer, expected_answer_contains array, must_not_contain array, should_abstain, should_ask_clarification, abstained,
    asked_clarification. Texts are looked for without regard to case; no answer is the empty one. A case that is to be answered fails
    if the system declined or asked back.
    """
    said = F.lower(F.coalesce("answer", F.lit("")))
    none = F.array().cast("array<string>")

    def holds(x: Column) -> Column:
        return F.contains(said, F.lower(x))

    expected = F.forall(F.coalesce("expected_answer_contains", none), holds)
    forbidden = F.exists(F.coalesce("must_not_contain", none), holds)
    right = F.when(F.col("should_ask_clarification"), F.col("asked_clarification")).when(F.col("should_abstain"), F.col("abstained")).otherwise(~F.col("abstained") & ~F.col("asked_clarification"))
    return cases.withColumns({"has_expected": expected, "has_forbidden": forbidden, "behaved": right})


def scope_precision(retrieved: Column, expected: Column) -> Column:
    """The share of retrieved municipalities that a question is about; null where it is about none or nothing was retrieved."""
    there = F.filter(retrieved, lambda x: F.array_contains(expected, x))
    return F.when((F.size(expected) > 0) & (F.size(retrieved) > 0), F.size(there) / F.size(retrieved))


def scope_leaks(runs: DataFrame) -> DataFrame:
    """The questions for which another municipality's text was retrieved: question_id, precision, leaked (sorted)."""
    found = runs.withColumn("precision", scope_precision(F.col("retrieved_municipalities"), F.col("expected_municipalities"))).filter("precision < 1")
    return found.select("question_id", "precision", F.array_sort(F.array_except("retrieved_municipalities", "expected_municipalities")).alias("leaked"))


def suite_report(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    return scored.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), rate(F.col("passed")).alias("pass_rate"), rate(F.col("retrieval_ok")).alias("retrieval_accuracy"), rate(F.col("behaved")).alias("behaviour_accuracy"), F.coalesce(F.avg("precision"), F.lit(0.0)).alias("citation_accuracy"),
        F.coalesce(F.sum("n_stale"), F.lit(0)).alias("stale"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"),
    )


def calibration(scored: DataFrame) -> DataFrame:
    """Pass rate of each confidence band; no band is ``unknown``."""
    named = F.when(F.coalesce("band", F.lit("")) == "", "unknown").otherwise(F.col("band"))
    return scored.groupBy(named.alias("band")).agg(F.count("*").alias("n"), rate(F.col("passed")).alias("pass_rate"))


def validation_report(runs: DataFrame) -> DataFrame:
    """One row of measures over validation runs (outcome, retrieval_ms, total_ms, citations, verified_citations, n_stale,
    retrieval_precision, expect_abstention, abstained, behaved, error)."""
    fine = F.coalesce("error", F.lit("")) == ""
    report = runs.agg(
        F.count("*").alias("n"),
        F.count_if(~fine).alias("errors"),
        F.coalesce(F.sum(F.col("verified_citations")) / F.nullif(F.sum("citations"), F.lit(0).cast("long")), F.lit(0.0)).alias("citation_verification_rate"),
        rate(F.col("citations") > 0, F.col("outcome") == "answered").alias("answers_with_citations"),
        F.count_if(F.col("n_stale") > 0).alias("stale_citations"),
        F.coalesce(F.avg("retrieval_precision"), F.lit(0.0)).alias("retrieval_precision"),
        rate(F.col("abstained")).alias("abstention_rate"),
        rate(F.col("abstained"), F.col("expect_abstention")).alias("correct_abstention_rate"),
        rate(F.col("abstained"), ~F.col("expect_abstention")).alias("false_abstention_rate"),
        rate(F.col("behaved")).alias("behaviour_accuracy"),
    )
    for column, name in (("retrieval_ms", "retrieval"), ("total_ms", "answer")):
        shares = {f"{name}_p50_ms": 0.50, f"{name}_p95_ms": 0.95}
        p = nearest_rank(runs.filter(fine & (F.col(column) > 0)).withColumn("_all", F.lit(1)), ["_all"], column, shares)
        report = report.withColumns({n: F.coalesce(p.select(n).scalar(), F.lit(0)) for n in shares})
    return report


def ingestion_report(corpus: DataFrame) -> DataFrame:
    """One row of measures over ingested documents (succeeded, n_sections, n_chunks, n_pages, n_ocr_pages, duration_s)."""
    fine = F.coalesce("succeeded", F.lit(False))
    chunks, pages = F.coalesce(F.sum("n_chunks"), F.lit(0)), F.coalesce(F.sum("n_pages"), F.lit(0))
    seconds = F.coalesce(F.sum(F.when(fine, F.col("duration_s"))), F.lit(0.0))
    return corpus.agg(
        F.count("*").alias("documents_attempted"),
        F.count_if(fine).alias("documents_ingested"),
        rate(fine).alias("ingestion_success_rate"),
        F.count_if(fine & (F.coalesce("n_sections", F.lit(0)) == 0)).alias("documents_without_sections"),
        chunks.alias("total_chunks"),
        pages.alias("total_pages"),
        F.when(pages > 0, F.sum("n_ocr_pages") / pages).otherwise(0.0).alias("ocr_page_rate"),
        F.when(seconds > 0, chunks / seconds).otherwise(0.0).alias("embedding_throughput"),
    )


def threshold_checks(report: DataFrame) -> DataFrame:
    """A row a criterion: name, value, passed, blocking. What the one-row ``report`` does not measure has no value and fails."""
    checks = []
    for name, bound in THRESHOLDS.items():
        value = F.col(name).cast("double") if name in report.columns else F.lit(None).cast("double")
        passed = (value <= bound) if name in AT_MOST else (value >= bound)
        checks.append(F.struct(F.lit(name).alias("name"), value.alias("value"), F.coalesce(passed, F.lit(False)).alias("passed"), F.lit(name not in NOT_BLOCKING).alias("blocking")))
    if "uncovered_city_abstains" in report.columns:  # only where the suite asks about a city outside the corpus
        value = F.col("uncovered_city_abstains").cast("double")
        checks.append(F.struct(F.lit("uncovered_city_abstains").alias("name"), value.alias("value"), F.coalesce(value == 1, F.lit(False)).alias("passed"), F.lit(True).alias("blocking")))
    return report.select(F.inline(F.array(*checks)))


def questions_for(questions: DataFrame, city: str) -> DataFrame:
    """The questions that expect a city."""
    return questions.filter(F.array_contains("expected_municipalities", city))


def behavioural(questions: DataFrame) -> DataFrame:
    """The questions to which declining, or asking back, is the right outcome."""
    return questions.filter(F.coalesce("expect_abstention", F.lit(False)) | F.coalesce("expect_clarification", F.lit(False)))


def milestone_passed(checks: DataFrame) -> DataFrame:
    return checks.agg(F.coalesce(F.bool_and(F.col("passed") | ~F.col("blocking")), F.lit(True)).alias("passed"))
