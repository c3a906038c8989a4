"""Tables lifted from the boxes of a page's lines: row bands and columns by sweeps, headers, and the prose that is left.

Spark brings a page's lines together, from top to bottom, by one shuffle; the sweeps run over columns of whole pages at a time. A
page of any length is swept in portions that end where a table does. Lines without a box, or with one of no area, are in no table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketspark.functions import text as T
from docketspark.operators.relational import box_join
from docketspark.session import lean, short_rows

PAGE = ["document_id", "page_number"]
PORTION = 1 << 13  # lines that are swept at once, at least


# fixed values: how all begin that Spark reads as a number; what does not is not tried, since each failure costs an exception
BEGINS_NUMBER = r"(?i)^[\x00-\x20]*[+-]?(\.?[0-9]|inf|nan)"


def looks_numeric(x: Column) -> Column:
    """Whether a cell is a number but for separators of thousands, percent and dollar signs."""
    plain = T.strip(F.regexp_replace(x, "[,%$]", ""))
    return T.bound(plain, lambda p: F.when(p.rlike(BEGINS_NUMBER), p.try_cast("double").isNotNull()).otherwise(False))


def has_header(rows: Column) -> Column:
    """Whether the first row reads as labels: of its cells that are filled at most half are numbers."""
    return T.bound(F.filter(F.element_at(rows, 1), lambda c: c != ""), lambda filled: (F.size(filled) > 0) & (2 * F.size(F.filter(filled, looks_numeric)) <= F.size(filled)))


def _begins(low: np.ndarray, high: np.ndarray, group: np.ndarray, gap: float = 0.0) -> np.ndarray:
    """Where a run of overlapping intervals begins, among those of one group; sorted by group and low."""
    order = np.argsort(high, kind="stable")  # no number is the largest, as in Spark
    rank = np.empty(len(high), np.int64)
    rank[order] = np.arange(len(high))
    reach = high[order[np.maximum.accumulate(group * len(high) + rank) - group * len(high)]]
    begins = np.ones(len(low), bool)
    begins[1:] = (group[1:] != group[:-1]) | (low[1:] >= reach[:-1] + gap)
    return begins


def _bands(rows: pa.RecordBatch, gap: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lines from top to bottom: their page's number, their band's, and of each band the first line and whether lines stand side by side."""
    y0, x0, y1, x1 = (rows.column(c).to_numpy() for c in ("y0", "x0", "y1", "x1"))
    page = np.cumsum(rows.column("n").to_numpy() == 1)
    starts = _begins(y0, y1, page)
    band = np.cumsum(starts) - 1
    at = np.lexsort((x1, x0, band))
    places = np.bincount(band[at], _begins(x0[at], x1[at], band[at], gap))
    return page, band, np.flatnonzero(starts), places >= 2


def _whole(rows: pa.RecordBatch, gap: float) -> tuple[int, bool]:
    """How many of the lines no later line can belong with, and whether they end with a page."""
    starts = np.flatnonzero(rows.column("n").to_numpy() == 1)
    if len(starts) and starts[-1]:
        return int(starts[-1]), True
    _, _, first, wide = _bands(rows, gap)  # of one page: the last band may go on, and so may the table that it ends
    narrow = np.flatnonzero(~wide[:-1])
    return (int(first[narrow[-1] + 1]) if len(narrow) else 0), False


def _joined(texts: pa.Array, ends: np.ndarray, by: str) -> pa.Array:
    """Texts of the lists that begin at ``ends``, the last of which is the end, joined."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), texts), by)


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


def _sweep(rows: pa.RecordBatch, min_rows: int, min_columns: int, gap: float) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """Tables of the lines, the number of each one's page, how many lines are in it."""
    y0, x0, y1, x1 = (rows.column(c).to_numpy() for c in ("y0", "x0", "y1", "x1"))
    page, band, first, wide = _bands(rows, gap)
    # bands of several lines that follow each other are a table
    follows = np.zeros(len(wide), bool)
    follows[1:] = wide[:-1] & (page[first[1:]] == page[first[:-1]])
    table_of = np.cumsum(wide & ~follows) - 1
    lines = np.flatnonzero(wide[band])
    table = table_of[band[lines]]
    at = np.lexsort((x0[lines], table))
    begins = _begins(x0[lines][at], x1[lines][at], table[at])
    column = np.empty(len(lines), np.int64)
    column[at] = np.cumsum(begins)
    n_columns = np.bincount(table[at], begins).astype(np.int64)
    column -= _ends(n_columns)[table] + 1
    n_rows = np.bincount(table_of[wide])
    found = (n_rows >= min_rows) & (n_columns >= min_columns)
    kept = found[table]
    lines, column, table = lines[kept], column[kept], (np.cumsum(found) - 1)[table[kept]]
    n_rows, n_columns = n_rows[found], n_columns[found]
    begin = np.flatnonzero(np.diff(table, prepend=-1))
    # a table's cells are numbered row by row, those without a line too
    row_ends, cell_ends = _ends(n_rows), _ends(n_rows * n_columns)
    cell = cell_ends[table] + (band[lines] - band[lines[begin]][table]) * n_columns[table] + column
    at = np.argsort(cell, kind="stable")  # a cell's lines stay from top to bottom and left to right
    texts, cell = rows.column("text").take(pa.array(lines[at])), cell[at]
    starts = np.flatnonzero(np.diff(cell, prepend=-1))
    place = np.full(cell_ends[-1], len(starts), np.int64)
    place[cell[starts]] = np.arange(len(starts))
    in_row = pa.array(_ends(np.repeat(n_columns, n_rows)), pa.int32())

    def grid(cells: pa.Array) -> pa.Array:
        return pa.concat_arrays([cells, pa.array([""])]).take(pa.array(place))

    filled = pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
    shown = _joined(texts.filter(pa.array(filled)), _ends(filled)[np.append(starts, len(cell))], " ")
    cells = texts if len(starts) == len(cell) else _joined(texts, np.append(starts, len(cell)), " ")
    made = pa.ListArray.from_arrays(pa.array(row_ends, pa.int32()), pa.ListArray.from_arrays(in_row, grid(cells)))
    # as functions.text.render_markdown: the first row, a rule, the others
    written = pc.binary_join_element_wise("| ", pc.binary_join(pa.ListArray.from_arrays(in_row, grid(pc.replace_substring(shown, "|", "\\|"))), " | "), " |", "")
    widths, own = np.unique(n_columns, return_inverse=True)
    tables, total = np.arange(len(n_rows)), row_ends[-1]
    line_ends = _ends(n_rows + 1)
    order = np.insert(np.arange(total), row_ends[:-1] + 1, total + own)
    markdown = _joined(pa.concat_arrays([written, pa.array(["|" + " --- |" * w for w in widths], pa.string())]).take(pa.array(order)), line_ends, "\n")
    box = [f.reduceat(v[lines], begin) if len(begin) else v[:0] for f, v in ((np.minimum, x0), (np.minimum, y0), (np.maximum, x1), (np.maximum, y1))]
    keys = [rows.column(c).take(pa.array(lines[begin])) for c in (*PAGE, "of")]
    columns = [*keys, made, markdown, pa.StructArray.from_arrays([pa.array(v) for v in box], names=["x0", "y0", "x1", "y1"])]
    return pa.RecordBatch.from_arrays(columns, names=[*PAGE, "of", "rows", "markdown", "box"]), page[lines[begin]], np.bincount(table, minlength=len(tables))


def _lift(batches: Iterator[pa.RecordBatch], min_rows: int, min_columns: int, gap: float) -> Iterator[pa.RecordBatch]:
    """Tables of pages, whose lines follow each other. What is held is a page's tables and the lines of one table, or of a portion of pages."""
    held, waits, size = [], PORTION, 0
    earlier, before, inside = [], 0, 0  # of a page that goes on: its tables, their number, the number of their lines

    def numbered(found: pa.RecordBatch, ordinal: np.ndarray, within: np.ndarray) -> pa.RecordBatch:
        left = found.column("of").to_numpy() - within
        return pa.RecordBatch.from_arrays([*(found.column(c) for c in PAGE), pa.array(ordinal, pa.int32()), *(found.column(c) for c in ("rows", "markdown", "box")), pa.array(left, pa.int64())], names=[*PAGE, "ordinal", "rows", "markdown", "box", "n_prose"])

    def swept(rows: pa.RecordBatch, ends_page: bool) -> Iterator[pa.RecordBatch]:
        nonlocal earlier, before, inside
        found, page, own = _sweep(rows, min_rows, min_columns, gap)
        goes_on = rows.column("n")[0].as_py() != 1
        ordinal = np.arange(len(page)) - np.searchsorted(page, page)
        within = np.bincount(page, own, minlength=rows.num_rows + 1).astype(np.int64)
        if goes_on:
            ordinal[page == 0] += before
            within[0] += inside
        if ends_page:
            for part in earlier:
                yield numbered(*part, within[0])
            earlier, before, inside = [], 0, 0
            yield numbered(found, ordinal, within[page])
        else:
            earlier, before, inside = [*earlier, (found, ordinal)], before * goes_on + len(page), int(within[0 if goes_on else 1])

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= waits:
            rows = pa.concat_batches(held)
            n, ends_page = _whole(rows, gap)
            if n:
                yield from swept(rows.slice(0, n), ends_page)
            held, size = [rows.slice(n)], rows.num_rows - n
            waits = max(PORTION, 2 * size)  # lines that a long table leaves are swept again only when they have doubled
    if size:
        yield from swept(pa.concat_batches(held), True)


def lift_tables(lines: DataFrame, min_rows: int = 2, min_columns: int = 2, gap: float = 1.0) -> DataFrame:
    """document_id, page_number, ordinal, rows array<array<string>>, headers array<string>, markdown, box, n_prose of every table.

    ``lines``: document_id, page_number, line_no, text, box struct<x0, y0, x1, y1>. Lines whose heights overlap are a band. Bands that
    stand together and have several lines side by side, at least ``gap`` apart, are a table; its columns are where the widths of all its
    lines overlap. A band of one line, such as a heading or prose, ends a table. Fewer than ``min_rows`` bands or ``min_columns``
    columns are none. Cells are the texts of their lines, from left to right and top to bottom; what is missing is the empty string.
    ``n_prose`` is the number of the page's lines that are in none of its tables.
    """
    short_rows(lines.sparkSession)
    b = F.col("box")
    area = (b["x1"] > b["x0"]) & (b["y1"] > b["y0"])
    boxed = lines.select(*PAGE, "line_no", T.squeeze(F.coalesce("text", F.lit(""))).alias("text"), *[F.when(area, b[c].cast("double")).alias(c) for c in ("y0", "x0", "y1", "x1")])
    down = W.partitionBy(*PAGE).orderBy(F.asc_nulls_last("y0"), "x0", "line_no", "text")
    all_of = down.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    given = boxed.withColumns({"n": F.row_number().over(down), "of": F.count("*").over(all_of)}).filter("y0 IS NOT NULL").select(*PAGE, "n", "of", "text", "y0", "x0", "y1", "x1")
    types = [f"{c} {lines.schema[c].dataType.simpleString()}" for c in PAGE]
    found = given.mapInArrow(lean(lambda batches: _lift(batches, min_rows, min_columns, gap)), f"{', '.join(types)}, ordinal int, rows array<array<string>>, markdown string, box struct<x0: double, y0: double, x1: double, y1: double>, n_prose long")
    headers = F.when(has_header(F.col("rows")), F.element_at("rows", 1)).otherwise(F.array().cast("array<string>"))
    return found.select(*PAGE, "ordinal", "rows", headers.alias("headers"), "markdown", "box", "n_prose")


def prose_lines(lines: DataFrame, tables: DataFrame, least: float = 0.5, cell: float = 200.0) -> DataFrame:
    """Lines that do not lie, by half or more, in a table of their page, in the columns of ``lines``. ``cell``: about a table's side."""
    inside = box_join(lines.select(*PAGE, "line_no", "box"), tables.select(*PAGE, F.col("box").alias("table_box")), PAGE, "box", "table_box", cell, least)
    return lines.join(inside.select(*PAGE, "line_no").distinct(), [*PAGE, "line_no"], "left_anti").select(*lines.columns)
