"""Language ID by prediction by partial matching (PPM): per-language context trees score exact code lengths.

A language's tree holds, for every context of 0 to 3 bytes seen in its sample, how often each byte followed. With
statistics frozen, a byte's code length is a fixed function of the three bytes before it: -log2 of its share where the
context has seen it, else the context's escape (method C: distinct / (total + distinct)) plus the length under the next
shorter context, down to one of 256 equal bytes. A context that a language never saw costs no escape. The text with the
least code length names the language; sums are in fixed point and do not depend on how rows are batched.

The trees of all languages share one trie of the grams that any of them saw, so tables are as large as the sample's grams
and languages, not as all contexts there could be: a node of order k is a gram of k + 1 bytes and, as a context, the parent of
the grams it begins. A node's children are found by rank in a 256-bit mask, so a text of any length is scored by look-ups over
blocks of its bytes. No context is left out.

Sample: at most about ``docs_per_language`` documents a language, taken by a hash of the id, and of each at most ``longest``
bytes, a stretch at a place that the hash gives; both are parameters, and scoring reads every whole text.

Defined cases: null text, or text without a letter: ``und`` with score 0; no labelled rows: ``und`` everywhere; a null id
is never learned from and not held out; languages of equal code length: the first by name; a text of any length is scored
whole, in blocks; repeated rows are predicted each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketspark.llm.common import append_columns, claim, ended_buffer, filled, long_text, slices

UNKNOWN = "und"
PAD = "\x00\x00\x00"
BITS = 1 << 16
BLOCK = 1 << 18
SCORE_BYTES = 32


def held_out(id_col: Column, folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % folds == fold, F.lit(False))


def sample(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, docs_per_language: int, longest: int) -> dict[str, list[bytes]]:
    """A bounded sample for the driver: by the id's hash, with the share that gives each language the wanted number."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    counts = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).withColumn("share", F.least(F.lit(1.0), F.lit(float(docs_per_language)) / F.col("n")))
    at = (F.xxhash64(F.lit("sample"), F.col(id_col)) / F.lit(2.0**64)) + 0.5
    drawn = rows.select(F.col(lang_col).alias("lang"), at.alias("at"), F.xxhash64(F.lit("place"), F.col(id_col)).alias("place"), F.encode(F.col(text_col), "UTF-8").alias("raw"))
    # one row a language: the languages' names are the model's size
    taken = drawn.join(F.broadcast(counts.select("lang", "share")), "lang").filter("at < share")
    start = F.pmod(F.col("place"), F.greatest(F.octet_length("raw") - longest, F.lit(0)) + 1).cast("int") + 1
    out: dict[str, list[bytes]] = {}
    for r in taken.select("lang", F.substring("raw", start, F.lit(longest)).alias("raw")).toLocalIterator():
        out.setdefault(r["lang"], []).append(bytes(r["raw"]))
    return {lang: sorted(texts) for lang, texts in sorted(out.items())}


ORDERS = 4


class Statistics:
    """Frozen counts of the sample; small, and what the workers get."""

    def __init__(self, texts: dict[str, list[bytes]]):
        self.key = uuid.uuid4().hex
        self.languages = list(texts)
        #: By language and order: distinct grams of order + 1 bytes as numbers, and how often each occurs.
        self.grams: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for lang in self.languages:
            orders: list[list[np.ndarray]] = [[] for _ in range(ORDERS)]
            for t in texts[lang]:
                gram = np.frombuffer(t, np.uint8).astype(np.uint32)
                for order in range(ORDERS):  # the start of a text is in no context
                    if order:
                        gram = (gram[:-1] << np.uint32(8)) | np.frombuffer(t, np.uint8)[order:]
                    orders[order].append(gram)
            self.grams.append([np.unique(np.concatenate(parts), return_counts=True) for parts in orders])


_WORD = np.arange(256) >> 6
_BIT = np.uint64(1) << (np.arange(256, dtype=np.uint64) & np.uint64(63))
_BELOW = _BIT - np.uint64(1)
DENSE = 1 << 9


class Level:
    """The trie's nodes of one order, all languages together, sorted; and the look-up of a node by its parent and its last byte."""

    def __init__(self, grams: np.ndarray, parents: np.ndarray, n_parents: int):
        self.grams = grams
        byte = (grams & 0xFF).astype(np.int64)
        at = 4 * parents + _WORD[byte]
        self.mask = np.zeros(4 * n_parents, np.uint64)
        np.bitwise_or.at(self.mask, at, _BIT[byte])
        per_word = np.bincount(at, minlength=4 * n_parents)
        self.before = (np.cumsum(per_word) - per_word).astype(np.int32)
        self.dense = None
        if n_parents < DENSE:  # as many parents as one byte has values: one table, with a last row for no parent
            self.dense = np.full((n_parents + 1, 256), -1, np.int32)
            self.dense[parents, byte] = np.arange(len(grams))

    def find(self, parent: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The nodes' numbers, -1 where there is none; ``parent`` may be -1 itself."""
        if self.dense is not None:
            return self.dense[parent, byte]
        at = parent * 4
        np.maximum(at, 0, out=at)
        at += _WORD[byte]
        mask = self.mask[at]
        found = self.before[at]
        found += np.bitwise_count(mask & _BELOW[byte])
        found[((mask & _BIT[byte]) == 0) | (parent < 0)] = -1
        return found


class Tables:
    """Code lengths of every language, in 1/65536 bit: of each node, and the escape of each node as a context."""

    def __init__(self, st: Statistics):
        n_lang = len(st.languages)
        self.n_lang = n_lang
        self.levels: list[Level] = []
        self.cost: list[np.ndarray] = []  # [node, language]: the length of the node's last byte after the bytes before it
        self.escape: list[np.ndarray] = []  # [parent, language]: what a byte costs that no child of the parent stands for
        parents_of = np.zeros(1, np.uint32)
        self.flat = round(8 * BITS)
        for order in range(ORDERS):
            grams = np.unique(np.concatenate([g[order][0] for g in st.grams]))
            own = np.zeros(len(grams), np.int64) if not order else np.searchsorted(parents_of, grams >> np.uint32(8))
            level = Level(grams, own, max(1, len(parents_of)))
            if order:  # lengths under the next shorter context, for languages that have not seen the gram
                mask = np.uint32((1 << 8 * order) - 1)
                lower = self.cost[-1][np.searchsorted(self.levels[-1].grams, grams & mask)].astype(np.float64)
            else:
                lower = np.full((len(grams), n_lang), float(self.flat))
            escape = np.zeros((max(1, len(parents_of)), n_lang))
            cost = np.empty((len(grams), n_lang))
            for j, g in enumerate(st.grams):
                seen, n = g[order]
                at = np.searchsorted(grams, seen)
                total = np.bincount(own[at], n, len(escape))
                distinct = np.bincount(own[at], minlength=len(escape))
                there = total > 0
                escape[there, j] = -np.log2(distinct[there] / (total[there] + distinct[there])) * BITS
                cost[:, j] = lower[:, j] + escape[own, j]
                cost[at, j] = -np.log2(n / (total[own[at]] + distinct[own[at]])) * BITS
            self.levels.append(level)
            self.cost.append(np.rint(cost).astype(np.int32))
            self.escape.append(np.rint(escape).astype(np.int32))
            parents_of = grams

    def costs(self, data: np.ndarray, n_before: np.ndarray, history: int) -> np.ndarray:
        """Lengths [byte, language] of ``data`` from ``history`` on; ``n_before``: bytes of its own text before each byte, up to 3."""
        nodes: list[np.ndarray] = []
        parent = np.zeros(len(data), np.int32)
        early = np.flatnonzero(n_before < ORDERS - 1)
        for order in range(ORDERS):
            if order:  # the gram one shorter that ends a byte earlier is the context
                parent = np.empty(len(data), np.int32)
                parent[0], parent[1:] = -1, nodes[-1][:-1]
                parent[early[n_before[early] < order]] = -1
            nodes.append(self.levels[order].find(parent, data))
        rest = np.arange(history, len(data))
        node = nodes[-1][history:]
        out = self.cost[-1][node]  # rows of the bytes without a node are set below
        rest = rest[node < 0]
        sums = np.zeros((len(rest), self.n_lang), np.int32)
        left = np.arange(len(rest))
        for order in range(ORDERS - 1, 0, -1):
            at = rest[left]
            context = np.where(n_before[at] >= order, nodes[order - 1][at - 1], -1)
            known = context >= 0
            sums[left[known]] += self.escape[order][context[known]]
            node = nodes[order - 1][at]
            hit = node >= 0
            sums[left[hit]] += self.cost[order - 1][node[hit]]
            left = left[~hit]
        sums[left] += self.flat + self.escape[0][0]
        out[rest - history] = sums
        return out

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code lengths [text, language] of texts that begin at ``offsets`` and are followed by the padding."""
        out = np.zeros((len(offsets) - 1, self.n_lang), np.int64)
        starts, ends = offsets[:-1], offsets[1:] - len(PAD)  # texts are never next to each other: the padding is between
        for p in range(0, len(data), BLOCK):
            q = min(p + BLOCK, len(data))
            history = min(p, ORDERS - 1)
            first, last = int(np.searchsorted(starts, p, "right")) - 1, int(np.searchsorted(starts, q, "left"))
            n_before = np.full(q - p + history, ORDERS - 1, np.int8)
            for k in range(ORDERS - 1):  # few bytes are near their text's start
                near = starts[(starts + k >= p - history) & (starts + k < q)] + k - (p - history)
                n_before[near] = np.minimum(n_before[near], k)
            cost = self.costs(data[p - history : q], n_before, history)
            # a text's part of this block, then its padding, in turn
            edges = np.empty(2 * (last - first), np.int64)
            edges[0::2], edges[1::2] = np.clip(starts[first:last], p, q) - p, np.clip(ends[first:last], p, q) - p
            sums = np.concatenate([np.zeros((1, self.n_lang), np.int64), np.cumsum(cost, axis=0, dtype=np.int64)])
            out[first:last] += sums[edges[1::2]] - sums[edges[0::2]]
        return out


def _tables(st: Statistics) -> Tables:
    tables = claim("language_id")
    if st.key not in tables:
        tables.clear()
        tables[st.key] = Tables(st)
    return tables[st.key]


class Model:
    def __init__(self, spark: SparkSession, texts: dict[str, list[bytes]]):
        self.statistics = Statistics(texts) if texts else None
        self.sent = spark.sparkContext.broadcast(self.statistics)  # bounded by the sample

    def columns(self) -> Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]]:
        sent = self.sent

        def make() -> Callable[[pa.RecordBatch], list[pa.Array]]:
            return lambda batch: predict(sent.value, batch.column(0))

        return make


def predict(st: Statistics | None, column: pa.Array) -> list[pa.Array]:
    """lang_pred and score of each text."""
    texts = filled(column)
    langs, scores = [], []
    for i, j in slices(texts):
        part = texts.slice(i, j - i)
        if (long := long_text(texts, i, j)) is not None:
            data, offsets = long, np.array([0, len(long) + len(PAD)])
        else:
            data, offsets = ended_buffer(part, PAD)
        starts, ends = offsets[:-1], offsets[1:] - len(PAD)
        ascii_letters = np.flatnonzero(((data | 32) >= 97) & ((data | 32) <= 122))
        lettered = np.searchsorted(ascii_letters, ends) > np.searchsorted(ascii_letters, starts)
        for k in np.flatnonzero(~lettered & (ends > starts)):
            lettered[k] = any(map(str.isalpha, part[int(k)].as_py()))
        if st is None:
            langs += [UNKNOWN] * len(part)
            scores += [0.0] * len(part)
            continue
        bits = _tables(st).lengths(data, offsets)
        best = bits.argmin(1)
        n = np.maximum(1, ends - starts)
        gap = (bits - bits.min(1, keepdims=True)) / BITS * np.minimum(1.0, SCORE_BYTES / n)[:, None]
        score = 1 / np.exp2(-np.minimum(gap, 1000)).sum(1)
        langs += [st.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
        scores += np.where(lettered, score, 0.0).tolist()
    return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 300, longest: int = 1 << 15) -> Model:
    """Learns from the rows of ``docs`` that are not held out and have a language."""
    texts = sample(docs.filter(~held_out(F.col(id_col))), id_col, text_col, lang_col, docs_per_language, longest)
    return Model(docs.sparkSession, texts)


def identify(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row`` (the columns of ``docs``, or those in ``carry``), lang_pred, score; the prediction reads the text only."""
    return append_columns(docs, [F.col(text_col)], model.columns(), "lang_pred string, score double", carry)
