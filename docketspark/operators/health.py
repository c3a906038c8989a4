"""Health: components' states rolled up, and the checks of this engine's own parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: states, and the components without which no question can be answered
STATES = ("ok", "degraded", "unavailable")
REQUIRED = ("tables", "vectors", "embedder", "generator")


def roll_up(components: DataFrame, by: list[str] | None = None, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """status and can_answer of ``components`` (name, status): the worst state, and whether all required ones are ok.

    A required component that was not checked is not ok.
    """
    state = F.col("status")
    fine = F.count_distinct(F.when((state == "ok") & F.col("name").isin(*required), F.col("name"))) == len(required)
    broken = F.coalesce(F.bool_or((state != "ok") & F.col("name").isin(*required)), F.lit(False))
    worst = F.when(F.bool_or(state == "unavailable"), "unavailable").when(F.bool_or(state == "degraded"), "degraded").otherwise("ok")
    return components.groupBy(*(by or [])).agg(worst.alias("status"), (fine & ~broken).alias("can_answer"), F.count("*").alias("n_components"))


def check(spark: SparkSession, data: str, names: tuple[str, ...], embedder=None, generator=None, reranker=None) -> DataFrame:
    """(name, status, detail) of the tables, the vectors and the plug-ins. Never raises: what fails is a state."""
    from pyspark.errors import AnalysisException

    from docketspark.session import table

    found: list[tuple[str, str, str]] = []
    missing, counted = [], 0
    for name in names:
        try:
            counted += bool(table(spark, data, name).columns)
        except AnalysisException:
            missing.append(name)
    found.append(("tables", "unavailable" if not counted else "degraded" if missing else "ok", f"missing: {', '.join(missing)}" if missing else f"{counted} tables"))
    if "embeddings" in missing or not counted:
        found.append(("vectors", "unavailable", "not checked: the table is not there"))
    else:
        widths = [r[0] for r in table(spark, data, "embeddings").select(F.size("embedding").alias("n")).distinct().limit(3).collect()]
        found.append(("vectors", "ok" if len(widths) == 1 else "unavailable" if not widths else "degraded", f"widths: {widths}"))
    for name, plugin, needed in (("embedder", embedder, True), ("generator", generator, True), ("reranker", reranker, False)):
        if plugin is None and not needed:
            continue
        try:
            found.append((name, "ok", type(plugin).__name__) if plugin is not None and (not hasattr(plugin, "ready") or plugin.ready()) else (name, "unavailable", "not ready" if plugin is not None else "not configured"))
        except Exception as e:  # noqa: BLE001 - a plug-in that raises is not there
            found.append((name, "unavailable", str(e)))
    return spark.createDataFrame(found, "name string, status string, detail string")
