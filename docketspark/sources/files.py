"""File sources and sinks: documents found and hashed, uploads checked, JSON suites, reports, snapshots."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import shutil
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType


def discover(spark: SparkSession, root: str, suffix: str = ".pdf", most_bytes: int | None = None) -> DataFrame:
    """Files under ``root`` (path, length, modificationTime), without hidden ones, folders included; the contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), F.lit("^" + _escaped(root)), F.lit(""))
    kept = found.filter(F.lower("path").endswith(suffix) & ~relative.rlike(r"(^|/)\."))
    return (kept if most_bytes is None else kept.filter(F.col("length") <= most_bytes)).orderBy("path")


def _escaped(root: str) -> str:
    import re

    return re.escape("/" + re.sub("^[a-z]+:/*", "/", root).strip("/"))


def hashed(spark: SparkSession, root: str) -> DataFrame:
    """path, length and SHA-256 of the content: a document's identity."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def new_documents(found: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose content no known document has, one of each content: checked before anything is extracted."""
    return found.dropDuplicates(["sha256"]).join(known.select("sha256"), "sha256", "left_anti")


def acceptable_upload(content: Column, name: Column) -> Column:
    """struct(ok, filename): PDF magic at the start, a name made of safe signs, no way out of the folder."""
    stem = F.regexp_replace(F.regexp_replace(F.element_at(F.split(name, r"[/\\]"), -1), r"(?i)\.pdf$", ""), "[^A-Za-z0-9_-]+", "-")
    safe = F.concat(F.coalesce(F.nullif(F.trim(F.lower(stem), F.lit("-")), F.lit("")), F.lit("document")), F.lit(".pdf"))
    return F.struct((F.substring(content, 1, 5) == F.lit(b"%PDF-")).alias("ok"), safe.alias("filename"))


LINE_SCHEMA = "path string, page_number int, line_no int, text string, font_size double, is_bold boolean, x0 double, y0 double, x1 double, y1 double"


def extract_lines(files: DataFrame, extractor: Callable[[bytes], list[tuple]] | None = None) -> DataFrame:
    """Lines of files by a plug-in that maps a content to rows of ``LINE_SCHEMA`` without the path. The default reads plain text.

    A file that fails gives one row with a null text, so failures are isolated and can be counted.
    """
    extractor = extractor or plain_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in LINE_SCHEMA.split(", ")]
        types = [{"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}[c.split()[1]] for c in LINE_SCHEMA.split(", ")]
        for batch in batches:
            out = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    out += [(path, *row) for row in extractor(content)]
                except Exception:  # noqa: BLE001 - one broken file must not end the run; its row says so
                    out.append((path, None, None, None, None, None, None, None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)

    return files.select("path", "content").mapInArrow(run, LINE_SCHEMA)


def plain_text(content: bytes) -> list[tuple]:
    return [(page, k, line, None, None, None, None, None, None) for page, body in enumerate(content.decode().split("\f"), 1) for k, line in enumerate(body.split("\n"))]


def probe_ocr(command: str = "tesseract", languages: tuple[str, ...] = ("eng",)) -> dict:
    """Whether an OCR program is there, which of the wanted languages it has, and why it can't be used if so. Never raises."""
    path = shutil.which(command)
    if not path:
        return {"available": False, "path": None, "languages": [], "reason": f"{command} is not installed"}
    try:
        done = subprocess.run([path, "--list-langs"], capture_output=True, text=True, timeout=10, check=False)
    except (OSError, subprocess.TimeoutExpired) as e:
        return {"available": False, "path": path, "languages": [], "reason": str(e)}
    there = set((done.stdout + done.stderr).split())
    missing = [x for x in languages if x not in there]
    reason = f"exit code {done.returncode}" if done.returncode else f"no language data: {', '.join(missing)}" if missing else None
    return {"available": reason is None, "path": path, "languages": [x for x in languages if x in there], "reason": reason}


def prefer_ocr(pages: DataFrame, ocr: DataFrame, least: float = 0.5, cap: float = 0.75) -> DataFrame:
    """Pages with OCR text where that is strictly better and the page was below ``least``; OCR confidence is capped.

    Pages below ``least`` without OCR text are flagged as skipped.
    """
    better = ocr.select("document_id", "page_number", F.col("text").alias("_text"), F.least("confidence", F.lit(cap)).alias("_confidence"))
    rows = pages.join(better, ["document_id", "page_number"], "left")
    poor = F.col("confidence") < least
    use = poor & (F.col("_confidence") > F.col("confidence"))
    taken = F.coalesce(use, F.lit(False))
    return rows.select(
        "document_id", "page_number", F.when(taken, F.col("_text")).otherwise(F.col("text")).alias("text"), F.when(taken, F.col("_confidence")).otherwise(F.col("confidence")).alias("confidence"), taken.alias("was_ocred"), (poor & F.col("_text").isNull()).alias("skipped")
    )


_TEXTS = ArrayType(StringType())
SUITE_SCHEMA = StructType(
    [
        StructField("name", StringType()),
        StructField(
            "cases",
            ArrayType(
                StructType(
                    [StructField(n, StringType()) for n in ("id", "question", "kind")]
                    + [StructField(n, _TEXTS) for n in ("expected_municipalities", "acceptable_sections")]
                    + [StructField("expected_pages", ArrayType(IntegerType()))]
                    + [StructField(n, _TEXTS) for n in ("expected_answer_contains", "must_not_contain")]
                    + [StructField(n, BooleanType()) for n in ("should_abstain", "should_ask_clarification", "answer_is_conditional")]
                    + [StructField(n, StringType()) for n in ("verified_by", "verified_on")]
                )
            ),
        ),
    ]
)


def read_suite(spark: SparkSession, path: str) -> DataFrame:
    """Golden cases, a row each, from JSON files {name, cases: [...]}."""
    return spark.read.schema(SUITE_SCHEMA).json(path, multiLine=True).select("name", F.inline("cases"))


def write_suite(cases: DataFrame, path: str) -> None:
    """One JSON file: a suite is small, a file a person edits."""
    packed = cases.groupBy("name").agg(F.collect_list(F.struct(*[c for c in cases.columns if c != "name"])).alias("cases"))
    packed.coalesce(1).write.mode("overwrite").json(path)


def verified(cases: DataFrame) -> DataFrame:
    return cases.filter(F.coalesce("verified_by", F.lit("")) != "")


def by_kind(cases: DataFrame, kind: str) -> DataFrame:
    return cases.filter(F.col("kind") == kind)


def by_municipality(cases: DataFrame, slug: str) -> DataFrame:
    return cases.filter(F.array_contains("expected_municipalities", slug))


def append_traces(traces: DataFrame, path: str | None) -> None:
    """Traces as JSON rows, appended; without a path they go nowhere."""
    if path:
        traces.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def replace_document(rows: DataFrame, path: str, key: str = "document_id") -> None:
    """Writes documents' rows so that only their own partitions are replaced: re-ingestion with its cascade."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def markdown_report(checks: DataFrame, title: str) -> str:
    """A report over threshold checks, which are a dozen rows."""
    lines = [f"# {title}", "", "| Check | Value | Result |", "| --- | --- | --- |"]
    for r in checks.orderBy("name").collect():
        result = "pass" if r["passed"] else "FAIL" if r["blocking"] else "warn"
        lines.append(f"| {r['name']} | {'not measured' if r['value'] is None else format(r['value'], 'g')} | {result} |")
    return "\n".join(lines) + "\n"


def missing_tables(spark: SparkSession, names: list[str]) -> list[str]:
    """Health probe: the tables that the catalog does not have."""
    return [n for n in names if not spark.catalog.tableExists(n)]
