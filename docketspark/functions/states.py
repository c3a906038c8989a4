"""Stages, states, labels and coordinates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketspark.functions.text import dashed

# fixed values: stages of ingestion in their order
STAGES = ("discovered", "hashed", "extracted", "ocr", "tables", "metadata", "sections", "chunked", "embedded", "indexed")


def stage_order(stage: Column) -> Column:
    """Position of a stage, null if it is none."""
    return F.nullif(F.array_position(F.array(*map(F.lit, STAGES)), stage), F.lit(0).cast("long"))


def is_at_least(stage: Column, other: Column) -> Column:
    return F.coalesce(stage_order(stage) >= stage_order(other), F.lit(False))


def document_state(stage: Column, error: Column) -> Column:
    """What a person is told: failed, ready or processing."""
    return F.when(F.coalesce(error, F.lit("")) != "", "failed").when(stage == "indexed", "ready").when(stage_order(stage).isNotNull(), "processing").otherwise("pending")


def job_state(status: Column) -> Column:
    return F.when(status == "failed", "failed").when(status == "completed", "ready").when(status == "running", "processing").otherwise("pending")


def as_ratios(box: Column, width: Column, height: Column) -> Column:
    """A box as shares of its page; null without a box or a page size."""
    fine = box.isNotNull() & (width > 0) & (height > 0)
    return F.when(fine, F.struct((box["x0"] / width).alias("x0"), (box["y0"] / height).alias("y0"), (box["x1"] / width).alias("x1"), (box["y1"] / height).alias("y1")))


def collection_name(model: Column, chunking: Column, version: Column) -> Column:
    return F.concat_ws("__", dashed(F.lower(F.element_at(F.split(model, "/"), -1))), F.concat(F.lit("c"), chunking.cast("string")), F.concat(F.lit("v"), version.cast("string")))


def deep_link(document: Column, page: Column) -> Column:
    return F.concat(F.lit("documents/"), document.cast("string"), F.coalesce(F.concat(F.lit("#page="), page.cast("string")), F.lit("")))
