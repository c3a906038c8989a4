"""Relational building blocks: provenance joins, ranked picks, nearest-rank percentiles, interval and box joins, keyed writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketspark.session import cut


def coverage(catalogue: DataFrame, facts: DataFrame, key: str, fact_key: str, counted: Column, name: str = "n") -> DataFrame:
    """Every catalogue row with the number of facts that satisfy ``counted``, 0 where there is none."""
    counts = facts.filter(counted).groupBy(F.col(fact_key).alias(key)).agg(F.count("*").alias(name))
    return catalogue.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def without(rows: DataFrame, others: DataFrame, key: str, other_key: str | None = None) -> DataFrame:
    """Rows for which ``others`` has no row of that key (NOT EXISTS)."""
    return rows.join(others.select(F.col(other_key or key).alias(key)), key, "left_anti")


def among(rows: DataFrame, others: DataFrame, key: str, other_key: str | None = None) -> DataFrame:
    """Rows for which ``others`` has a row of that key (EXISTS)."""
    return rows.join(others.select(F.col(other_key or key).alias(key)), key, "left_semi")


def top_k(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows; the last order column must be a unique key, so ties are settled."""
    return rows.orderBy(*order).limit(k)


def top_k_per(rows: DataFrame, k: int, by: list[str], *order: Column, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their 1-based rank."""
    return rows.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def first_per(rows: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """One row of each group, the first in order; arg-max and arg-min with stated ties, and latest state."""
    return top_k_per(rows, 1, by, *order, rank="_first").drop("_first")


def weighted_mode(rows: DataFrame, by: list[str], value: Column, weight: Column, position: Column, name: str = "mode") -> DataFrame:
    """The value of the greatest weight in each group; of equal weights the one met first."""
    sums = rows.groupBy(*by, value.alias(name)).agg(F.sum(weight).alias("_weight"), F.min(position).alias("_at"))
    best = sums.groupBy(*by).agg(F.min_by(name, F.struct((-F.col("_weight")).alias("w"), F.col("_at"))).alias(name), F.max("_weight").alias("weight"))
    return best


SORTED = 1 << 20  # distinct values of a group that one task may order
BINS = 1024


def nearest_rank(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], most_sorted: int = SORTED) -> DataFrame:
    """Nearest-rank percentiles: element ``min(n - 1, floor(n * p))`` of the sorted values, without collecting a group.

    Values are counted first, so repeats never move. Groups of up to ``most_sorted`` different values are ranked by a window over these
    counts. If there are larger ones, ranks are selected by histograms of ``BINS`` bins that are refined around each rank, so no
    task orders a group. Not a number and null do not count.
    """
    v = F.col(value)
    given = rows.filter(v.isNotNull() & ~F.isnan(v.cast("double")))
    counts = cut(given.groupBy(*by, v.alias("_v")).agg(F.count("*").alias("_c")), "counts")
    totals = counts.groupBy(*by).agg(F.sum("_c").alias("n"), F.count("*").alias("_different"))
    if (totals.agg(F.max("_different").alias("most")).first()["most"] or 0) > most_sorted:
        return _selected(counts, cut(totals.drop("_different"), "totals"), by, shares)
    order = W.partitionBy(*by).orderBy("_v")
    placed = counts.withColumn("_upto", F.sum("_c").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(W.partitionBy(*by)))
    picks = [F.min(F.when(F.col("_upto") >= F.least(F.col("_n"), F.floor(F.col("_n") * p) + 1), F.col("_v"))).alias(name) for name, p in shares.items()]
    return placed.groupBy(*by).agg(F.max("_n").alias("n"), *picks)


def _selected(counts: DataFrame, totals: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """The ranks by refinement: of each (group, share) a range that holds its rank, and how many values lie below the range.

    A round counts a range's values in equal bins and goes on with the one that holds the rank, from its least to its greatest value, so
    it ends when these are one. What a round shuffles is bins, added up before they move.
    """
    places = F.inline(F.array(*[F.struct(F.lit(name).alias("_share"), F.least(F.col("n"), F.floor(F.col("n") * p) + 1).alias("_rank")) for name, p in shares.items()]))
    bounds = counts.groupBy(*by).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    key = [*by, "_share"]
    state = cut(totals.select(*by, places).join(bounds, by).withColumn("_below", F.expr("0L")), "ranges")
    while True:
        wide = state.filter("_low < _high")
        if wide.isEmpty():
            break
        low, high = F.col("_low").cast("double"), F.col("_high").cast("double")
        # halves keep the difference of the largest doubles finite
        at = F.floor((F.col("_v").cast("double") / 2 - low / 2) / (high / 2 - low / 2) * BINS)
        inside = counts.join(wide, by).filter(F.col("_v").between(F.col("_low"), F.col("_high"))).withColumn("_bin", F.least(F.greatest(at, F.lit(0)), F.lit(BINS - 1)))
        bins = inside.groupBy(*key, "_rank", "_below", "_bin").agg(F.sum("_c").alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        order = W.partitionBy(*key).orderBy("_bin")
        upto = F.col("_below") + F.sum("_c").over(order.rowsBetween(W.unboundedPreceding, 0))
        found = bins.withColumn("_upto", upto).filter((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_c") < F.col("_rank")))
        columns = state.columns
        narrowed = found.withColumn("_below", F.col("_upto") - F.col("_c")).select(*columns)
        state = cut(state.filter("_low >= _high").unionByName(narrowed), "ranges")
    picks = [F.max(F.when(F.col("_share") == name, F.col("_low"))).alias(name) for name in shares]
    return totals.join(state.groupBy(*by).agg(*picks), by).select(*by, "n", *shares)


def interval_join(points: DataFrame, spans: DataFrame, by: list[str], at: str, low: str, high: str, depth: str, tie: str, width: int) -> DataFrame:
    """Each point with the deepest span that contains it, the first of equal depth; points without one stay.

    Spans are dealt into bins of ``width``, so the join is on (keys, bin) and no pair outside a bin is formed.
    """
    binned = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    keyed = points.withColumn("_bin", F.floor(F.col(at) / width)).withColumn("_row", F.monotonically_increasing_id())
    hits = keyed.select("_row", *by, "_bin", at).join(binned, [*by, "_bin"]).filter(F.col(at).between(F.col(low), F.col(high)))
    names = [c for c in spans.columns if c not in by]
    best = hits.groupBy("_row").agg(F.min_by(F.struct(*names), F.struct((-F.col(depth)).alias("d"), F.col(tie).alias("t"))).alias("_best"))
    return keyed.join(best, "_row", "left").select(*points.columns, *[F.col(f"_best.{c}").alias(c) for c in names])


def overlap_share(line: Column, box: Column) -> Column:
    """Share of ``line``'s area that lies in ``box``; both are structs x0, y0, x1, y1. An empty line has share 0, so has a null one and any in a null box."""
    wide = F.greatest(F.lit(0.0), F.least(line["x1"], box["x1"]) - F.greatest(line["x0"], box["x0"]))
    high = F.greatest(F.lit(0.0), F.least(line["y1"], box["y1"]) - F.greatest(line["y0"], box["y0"]))
    area = (line["x1"] - line["x0"]) * (line["y1"] - line["y0"])
    known = (box["x0"] + box["y0"] + box["x1"] + box["y1"]).isNotNull()  # least and greatest skip nulls
    return F.when((area > 0) & known, wide * high / area).otherwise(0.0)


def box_join(lines: DataFrame, boxes: DataFrame, by: list[str], line: str, box: str, cell: float, least: float = 0.5) -> DataFrame:
    """Pairs of the same keys with at least the share ``least`` of the line's area in the box, as ``share``.

    A line with half its width and height in a box has its centre there, so it is dealt to the one cell of its centre and a box to
    all cells it touches: the join is on (keys, cell), forms no pair twice and none of distant boxes. ``cell`` is about a usual
    box's side; larger boxes take more rows. Lines without an area, and null boxes, pair with nothing. ``least`` is 0.5 or more.
    """
    if least < 0.5:
        raise ValueError("a line's centre tells its boxes only from a share of 0.5 on")

    def at(x: Column) -> Column:
        return F.floor(x / cell)

    def cells(low: Column, high: Column) -> Column:
        return F.sequence(at(low - cell / 1e6), at(high + cell / 1e6))  # a margin for rounding

    a, b = F.col(line), F.col(box)
    dealt = lines.filter((a["x1"] > a["x0"]) & (a["y1"] > a["y0"])).withColumns({"_x": at((a["x0"] + a["x1"]) / 2), "_y": at((a["y0"] + a["y1"]) / 2)})
    spread = boxes.filter((b["x1"] >= b["x0"]) & (b["y1"] >= b["y0"])).withColumn("_x", F.explode(cells(b["x0"], b["x1"]))).withColumn("_y", F.explode(cells(b["y0"], b["y1"])))
    return dealt.join(spread, [*by, "_x", "_y"]).drop("_x", "_y").withColumn("share", overlap_share(a, b)).filter(F.col("share") >= least)


def conflict_groups(rows: DataFrame, by: list[str], source: str, title: str, position: str) -> DataFrame:
    """Groups that more than one source speaks to, with the distinct titles in the order they are met.

    One scan: rows are reduced to a first position per source and title before anything is gathered.
    """
    firsts = rows.groupBy(*by, F.col(source).alias("_source"), F.col(title).alias("_title")).agg(F.min(position).alias("_at"))
    met = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_title"))), lambda x: x["_title"].cast("string"))
    groups = firsts.groupBy(*by).agg(F.count_distinct("_source").alias("n_sources"), F.array_join(F.array_distinct(met), "|").alias("titles"))
    return groups.filter("n_sources >= 2")


def margin(best: Column, total: Column, n: Column) -> Column:
    """(best - mean of the rest) / |best|."""
    return (best - (total - best) / (n - 1)) / F.abs(best)


# --- keyed writes, as projections whose result overwrites the table


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Target with the changes applied, the last change of a key winning."""
    latest = changes.groupBy(*keys).agg(F.max_by(F.struct(*changes.columns), order).alias("_c")).select("_c.*")
    kept = target.join(latest.select(*keys), keys, "left_anti")
    return kept.unionByName(latest.select(*target.columns))


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Target with those rows added whose key it does not hold (DO NOTHING on conflict)."""
    new = rows.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(new.select(*target.columns))


def guarded_update(target: DataFrame, changes: DataFrame, keys: list[str], columns: list[str], verified: str) -> DataFrame:
    """Columns take the change's value unless a person verified the row; a null change keeps the old value."""
    new = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = target.join(new, keys, "left")
    return joined.withColumns({c: F.when(F.col(verified), F.col(c)).otherwise(F.coalesce(f"_new_{c}", c)) for c in columns}).select(*target.columns)


def activate(collections: DataFrame, chosen: Column, status: str = "status") -> DataFrame:
    """The chosen collection becomes the one active, what was active is retired."""
    return collections.withColumn(status, F.when(chosen, "active").when(F.col(status) == "active", "retired").otherwise(F.col(status)))


def quarantine(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all checks, rows that break one, with the names of those broken). A null check counts as kept."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in checks.items()]))
    marked = rows.withColumn("broken", broken)
    return marked.filter(F.size("broken") == 0).drop("broken"), marked.filter(F.size("broken") > 0)


def ancestors_offset(rows: DataFrame, by: list[str], order: list[str], length: str, gap: int = 1, name: str = "char_start") -> DataFrame:
    """Running character offset: the lengths of all rows before, each with its line break."""
    before = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(F.col(length) + gap).over(before), F.lit(0)))
