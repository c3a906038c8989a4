"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text features.

P(grade > k) = sigmoid(w . x - t_k): one weight vector for all grades and ordered thresholds t_0 < t_1 < ... . It gives an
expected grade and the probability of the grades from any level on, which is what selection thresholds. Features are the
presence of the text's runs of word or sign characters, hashed into 2**18 columns, and of how large a share of the runs
repeats the run before. A feature's value is the log odds ratio with which it tells the sampled documents above a threshold
from those below, the mean of the thresholds by their lesser side; so a few telling words stand out of a long text. A text's values are scaled to
length one over its known features.

The fit takes of each grade the ``docs_per_grade`` rated documents with the least hashes of their ids, each once a grade however
often it was rated, and of each at most ``longest`` bytes, a stretch at a place that the hash gives; both are parameters, and the
documents that the fold holds out are never among them. A sampled document weighs its own ratings, times its grade's ratings by
those sampled, so the thresholds follow the grades' shares among all ratings, whatever their number. Scoring reads every whole text.

Defined cases: null or empty text has no features and gets the thresholds' prior; no ratings: expected grade null, tail null,
kept; ratings that are null, not of 0 to ``n_grades`` - 1 or of no document are not learned from; a document rated twice counts
twice; of documents that share an id the one with the least stretch is learned from; a grade without ratings keeps its threshold
next to its neighbour's; the fit does not depend on the order of rows or files; equal texts have equal results; a text of any length is read whole, in pieces of 1 MB; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketspark.llm.common import append_columns, ended_buffer, filled, long_text, mix, pieces, slices, word_hashes
from docketspark.session import cut

LOG2_COLUMNS = 18
LEAST_DOCS = 4  # of the sample, that a column must occur in

_CLASS = np.ones(256, np.uint8)
_CLASS[:48] = _CLASS[58:65] = _CLASS[91:97] = _CLASS[123:128] = 2
_CLASS[[32, *range(9, 14)]] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


_REPEATS = (0.02, 0.1, 0.4)
_MARKER = int(mix(np.array([99], np.uint64), 5)[0] >> np.uint64(64 - LOG2_COLUMNS))


def _runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the runs of word or sign characters."""
    kind = _CLASS[data]
    edge = np.flatnonzero(np.diff(kind, prepend=np.uint8(0), append=np.uint8(0)))
    starts, ends = edge[:-1], edge[1:]
    solid = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
    return starts[solid], word_hashes(_LOWER[data], starts[solid], ends[solid])


def _columns(found: np.ndarray, n_runs: int, n_again: int) -> np.ndarray:
    """The columns of a text: of its runs, and of the shares of runs that repeat the one before."""
    extra = [(_MARKER + k) % (1 << LOG2_COLUMNS) for k, share in enumerate(_REPEATS) if n_runs and n_again >= share * n_runs]
    return np.union1d(found, extra).astype(np.int64) if extra else found


def _column(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - LOG2_COLUMNS)).astype(np.int64)


def _long_features(data: np.ndarray) -> np.ndarray:
    found, n_runs, n_again, last = np.zeros(0, np.int64), 0, 0, None
    for a, b in pieces(data, _CLASS == 0):
        _, hashes = _runs(data[a:b])
        if len(hashes):
            n_again += int((hashes[1:] == hashes[:-1]).sum()) + (hashes[0] == last)
            n_runs, last = n_runs + len(hashes), hashes[-1]
            found = np.union1d(found, _column(hashes))
    return _columns(found, n_runs, n_again)


def features(texts: pa.Array) -> list[np.ndarray]:
    """Per text the sorted distinct columns that are present."""
    out: list[np.ndarray] = []
    for i, j in slices(texts):
        if (long := long_text(texts, i, j)) is not None:
            out.append(_long_features(long))
            continue
        data, offsets = ended_buffer(texts.slice(i, j - i))
        starts, hashes = _runs(data)
        columns = _column(hashes)
        again = np.zeros(len(hashes), bool)
        again[1:] = hashes[1:] == hashes[:-1]
        bounds = np.searchsorted(starts, offsets)
        out += [_columns(np.unique(columns[a:b]), b - a, int(again[a + 1 : b].sum())) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return out


class Cumulative:
    """Features' values, weights and thresholds; ``fit`` minimises the penalised likelihood by accelerated gradient steps."""

    def __init__(self, values: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        """``values``: 0 for features that are not known."""
        self.values, self.weights, self.thresholds = values.astype(np.float32), weights.astype(np.float32), thresholds

    @staticmethod
    def telling(rows: list[np.ndarray], above: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Each known feature's mean log odds ratio over the thresholds, with one document added to every count."""
        out, total = np.zeros(len(known)), 0
        for high in above.T.astype(bool):
            if high.all() or not high.any():
                continue
            shares = []
            for side in (high, ~high):
                n = np.bincount(np.concatenate([r for r, s in zip(rows, side, strict=True) if s]), minlength=len(known))
                shares.append((n + 1) / (side.sum() + 2))
            lesser = min(high.sum(), (~high).sum())
            out, total = out + lesser * np.abs(np.log(shares[0] / shares[1])), total + lesser
        return np.where(known, np.maximum(out / max(total, 1), 1e-3), 0.0)

    @staticmethod
    def scaled(rows: list[np.ndarray], values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, column and value of the known features."""
        kept = [r[values[r] > 0] for r in rows]
        at = np.repeat(np.arange(len(kept)), [len(r) for r in kept])
        column = np.concatenate(kept) if kept else np.zeros(0, np.int64)
        value = values[column].astype(float)
        return at, column, value / np.sqrt(np.bincount(at, value * value, len(kept)))[at]

    @classmethod
    def fit(cls, rows: list[np.ndarray], grades: np.ndarray, n_grades: int, penalty: float = 0.003, steps: int = 400, weights: np.ndarray | None = None) -> Cumulative:
        """``weights``: what each row counts, one each if null; only their proportions matter."""
        if n_grades < 2:
            raise ValueError("grades are two at least")
        n_columns = 1 << LOG2_COLUMNS
        docs = np.bincount(np.concatenate(rows), minlength=n_columns) if rows else np.zeros(n_columns, np.int64)
        above = (grades[:, None] > np.arange(n_grades - 1)).astype(float)
        values = cls.telling(rows, above, docs >= LEAST_DOCS)
        at, column, value = cls.scaled(rows, values)
        n = max(1, len(rows))
        each = np.ones(len(rows)) if weights is None else weights * (len(rows) / weights.sum())
        shares = ((each @ above) + 0.5) / (n + 1)
        thresholds = np.maximum.accumulate(-np.log(shares / (1 - shares)))
        w, rate = np.zeros(n_columns), 4.0 / (n_grades - 1)
        ahead, ahead_t = w.copy(), thresholds.copy()
        for step in range(1, steps + 1):
            score = np.bincount(at, ahead[column] * value, n)[: len(rows)]
            wrong = each[:, None] * (1 / (1 + np.exp(-(score[:, None] - ahead_t))) - above)
            slope = np.bincount(column, wrong.sum(1)[at] * value, n_columns) / n + penalty / n * 10 * ahead
            new, new_t = ahead - rate * slope, np.maximum.accumulate(ahead_t + rate * wrong.mean(0))
            pull = (step - 1) / (step + 2)
            ahead, ahead_t = new + pull * (new - w), new_t + pull * (new_t - thresholds)
            w, thresholds = new, new_t
        return cls(values, w, thresholds)

    def tails(self, rows: list[np.ndarray]) -> np.ndarray:
        """P(grade > k) for every row and k."""
        at, column, value = self.scaled(rows, self.values)
        score = np.bincount(at, self.weights[column] * value, len(rows))[: len(rows)] if len(rows) else np.zeros(0)
        return 1 / (1 + np.exp(-(score[:, None] - self.thresholds)))


def grade_of(quality, toxic):
    """0 to 2: a point for quality and one for not being toxic."""
    return quality + 1 - toxic


def sample(docs: DataFrame, ratings: DataFrame, n_grades: int, id_col: str, text_col: str, grade_col: str, docs_per_grade: int, longest: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts, their grades, and how many ratings of its grade each stands for; in an order that does not depend on partitions."""
    rated = ratings.select(F.col(id_col).alias("rated_id"), F.col(grade_col).cast("int").alias("grade")).filter(F.col("rated_id").isNotNull() & F.col("grade").between(0, n_grades - 1))
    once = rated.groupBy("rated_id", "grade").agg(F.count("*").alias("n"))  # a document with however many ratings is one row a grade
    known = cut(once.join(docs.select(F.col(id_col).alias("rated_id")), "rated_id", "left_semi"), "rated")
    counts = {r["grade"]: r["n"] for r in known.groupBy("grade").agg(F.sum("n").alias("n")).collect()}  # one row a grade
    order = W.partitionBy("grade").orderBy(F.xxhash64(F.lit("rated"), "rated_id"), "rated_id")
    # the least hashes of each grade: docs_per_grade * n_grades rows at most, which is the size of what is broadcast
    chosen = cut(known.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= docs_per_grade), "chosen")
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    start = F.pmod(F.xxhash64(F.lit("place"), "rated_id"), F.greatest(F.octet_length("raw") - longest, F.lit(0)) + 1).cast("int") + 1
    texts = docs.select(F.col(id_col).alias("rated_id"), raw.alias("raw"))
    pieces_of = texts.join(F.broadcast(chosen), "rated_id").select("grade", "place", "n", F.substring("raw", start, F.lit(longest)).alias("raw"))
    # where documents share an id, one of them stands for it
    got = pieces_of.groupBy("grade", "place", "n").agg(F.min("raw").alias("raw")).orderBy("grade", "place").collect()
    sampled = Counter()
    for r in got:
        sampled[r["grade"]] += r["n"]
    return [bytes(r["raw"]) for r in got], np.array([r["grade"] for r in got], np.int64), np.array([r["n"] * (counts[r["grade"]] / sampled[r["grade"]]) for r in got])


class Model:
    def __init__(self, spark: SparkSession, fitted: Cumulative | None, n_grades: int):
        self.n_grades = n_grades
        self.sent = spark.sparkContext.broadcast(fitted)  # 2**18 weights and values, whatever the data

    def columns(self, level: int) -> Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]]:
        sent, n_grades = self.sent, self.n_grades

        def make() -> Callable[[pa.RecordBatch], list[pa.Array]]:
            def step(batch: pa.RecordBatch) -> list[pa.Array]:
                if sent.value is None:
                    return [pa.nulls(batch.num_rows, pa.float64())] * 2
                tails = sent.value.tails(features(filled(batch.column(0)))).reshape(-1, n_grades - 1)
                return [pa.array(tails.sum(1)), pa.array(tails[:, level - 1])]

            return step

        return make


def fit(docs: DataFrame, ratings: DataFrame, n_grades: int, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", docs_per_grade: int = 2000, longest: int = 1 << 15) -> Model:
    if n_grades < 2:
        raise ValueError("grades are two at least")
    texts, grades, weights = sample(docs, ratings, n_grades, id_col, text_col, grade_col, docs_per_grade, longest)
    fitted = Cumulative.fit(features(pa.array([t.decode("utf-8", "ignore") for t in texts], pa.string())), grades, n_grades, weights=weights) if texts else None
    return Model(docs.sparkSession, fitted, n_grades)


def rate(docs: DataFrame, model: Model, level: int, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row``, expected_grade, tail (probability of a grade of ``level`` or more)."""
    return append_columns(docs, [F.col(text_col)], model.columns(level), "expected_grade double, tail double", carry)
