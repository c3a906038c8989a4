"""Benchmark decontamination by Wu-Manber multi-pattern search over normalised words.

Documents and benchmark items are reduced to their words, A-Z lower-cased, with one space around each. The patterns are
the items' windows of ``window`` consecutive words (an item of fewer words is one window). With m the least pattern
length and blocks of ``BLOCK`` bytes, a shift table over hashed blocks says how far the search may jump: a block that
stands in no pattern's first m bytes lets it skip m - BLOCK + 1 positions. Where the shift is 0 the block is the suffix
of some pattern's first m bytes; its bucket names the patterns, and direct comparison confirms an occurrence.

The search runs in lockstep over many segments of a batch at once, so the jumps are array operations. Short patterns would
shorten every jump, so patterns are put into classes of similar length, each with a table of its own. Items are streamed
from the benchmark in blocks of at most ``most_items`` and ``most_bytes``; one with more takes more passes, and their
findings are merged row by row. What is broadcast, and what a worker keeps, is one block a pass; after every
``PASSES_AT_ONCE`` passes the state is a written table. Only a single item longer than ``most_bytes`` makes a larger block.

Defined cases: null text has no words and is not contaminated; an item without words is no pattern; repeated items count
each by their id; an item without an id hits words but is not listed; items of the same words are found together; a long
text is searched in pieces of 1 MB that overlap by the longest pattern; an empty benchmark finds nothing; repeated rows are
judged each; an empty table gives no rows; the columns of the table come back in ``row`` untouched.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketspark.llm.common import append_columns, claim, ended_buffer, filled, long_text, mix, pieces, slices, word_spans
from docketspark.session import cut

WINDOW = 13
BLOCK = 8
LOG2_SHIFTS = 22
SEGMENT = 2048
MOST_ITEMS, MOST_BYTES = 20_000, 1 << 20
PASSES_AT_ONCE = 4
SHORT = (12, 32)  # patterns shorter than these have tables of their own

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:48] = _FOLD[58:65] = _FOLD[91:97] = _FOLD[123:128] = 32
_FOLD[65:91] += 32


def normalised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes " w1 w2 ... wn " of every text with a line end after it; starts of the words; offsets of the texts."""
    data, offsets = ended_buffer(texts)
    data = _FOLD[data]
    gap = data == 32
    keep = np.ones(len(data), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    line_ends = offsets[1:] - 1
    keep[line_ends] = True
    # every text gets a space before its first word, one after its last, and a line end
    marked = data.copy()
    marked[line_ends] = 10
    first_gap = np.zeros(len(data), bool)
    nonempty = offsets[:-1] < line_ends
    first_gap[offsets[:-1][nonempty]] = True
    last = line_ends[nonempty] - 1
    before = np.flatnonzero(first_gap & (marked != 32))
    after = last[marked[last] != 32] + 1
    # a text's leading gap may follow the line end of the one before, which folded to a gap too
    keep[offsets[:-1][nonempty]] = True
    at = np.concatenate([before, after])
    values = np.full(len(at), 32, np.uint8)
    kept_before = np.concatenate([[0], np.cumsum(keep)])
    out = np.insert(marked[keep], kept_before[at], values)
    added = np.zeros(len(data) + 1, np.int64)
    np.add.at(added, at, 1)
    added = np.cumsum(added)
    ends = np.flatnonzero(out == 10)
    new_offsets = np.concatenate([[0], ends + 1])
    starts, _ = word_spans((out == 32) | (out == 10)) if len(out) else (np.zeros(0, np.int64),) * 2
    return out, starts, new_offsets


def words_of(text: str) -> list[str]:
    """The words of one text, as the search sees them."""
    return _FOLD[np.frombuffer((text or "").encode(), np.uint8)].tobytes().decode().split(" ") if text else []


def windows(items: list[tuple[object, str]], window: int = WINDOW) -> dict[bytes, list[int]]:
    """Pattern bytes and the items (by position) that have them."""
    found: dict[bytes, list[int]] = {}
    for i, (_, text) in enumerate(items):
        words = [w for w in words_of(text) if w]
        for k in range(max(1, len(words) - window + 1) if words else 0):
            pattern = f" {' '.join(words[k : k + window])} ".encode()
            owners = found.setdefault(pattern, [])
            if not owners or owners[-1] != i:
                owners.append(i)
    return found


def _hash(data: np.ndarray, at: np.ndarray, block: int) -> np.ndarray:
    """Hash of the block that ends at each position."""
    h = data[at].astype(np.uint64)
    for k in range(1, block):
        h = (h << np.uint64(8)) | data[at - k]
    return (mix(h) >> np.uint64(64 - LOG2_SHIFTS)).astype(np.int64)


class ShiftTable:
    """Wu-Manber tables of patterns of at least ``self.m`` bytes."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.m = min(map(len, patterns))
        self.block = min(BLOCK, self.m)
        self.shift = np.full(1 << LOG2_SHIFTS, self.m - self.block + 1, np.int16 if self.m < 30000 else np.int32)
        heads = np.frombuffer(b"".join(p[: self.m] for p in patterns), np.uint8)
        base = np.arange(len(patterns), dtype=np.int64) * self.m
        for end in range(self.block - 1, self.m):
            at = _hash(heads, base + end, self.block)
            self.shift[at] = np.minimum(self.shift[at], self.m - 1 - end)
        self.buckets: dict[int, list[int]] = {}
        for i, h in enumerate(_hash(heads, base + self.m - 1, self.block).tolist()):
            self.buckets.setdefault(h, []).append(i)

    def search(self, data: np.ndarray) -> Iterator[tuple[int, int]]:
        """(position, pattern) of every occurrence; positions are where the pattern begins."""
        n = len(data)
        pos = np.arange(self.m - 1, n, SEGMENT, dtype=np.int64)
        stop = np.minimum(pos + SEGMENT, n)
        raw = data.tobytes()
        while len(pos):
            h = _hash(data, pos, self.block)
            jump = self.shift[h]
            for p, bucket in zip(pos[jump == 0].tolist(), h[jump == 0].tolist(), strict=True):
                begin = p - self.m + 1
                for i in self.buckets.get(bucket, ()):
                    if raw.startswith(self.patterns[i], begin):
                        yield begin, i
            pos = pos + np.maximum(jump, 1)
            live = pos < stop
            pos, stop = pos[live], stop[live]


class Searcher:
    """All patterns of one block, in classes of similar length."""

    def __init__(self, found: dict[bytes, list[int]]):
        self.classes = []
        edges = [0, *SHORT, 1 << 60]
        for low, high in zip(edges, edges[1:], strict=False):
            patterns = [p for p in found if low <= len(p) < high]
            if patterns:
                self.classes.append((ShiftTable(patterns), [found[p] for p in patterns], [p.count(b" ") - 1 for p in patterns]))
        self.longest = max((max(n) for *_, n in self.classes), default=1)

    def judge(self, texts: pa.Array) -> Iterator[tuple[int, list[tuple[int, int]], set[int]]]:
        """Per text: number of words, hit word ranges [from, to), items found."""
        data, starts, offsets = normalised(texts)
        doc_words = np.searchsorted(starts, offsets)
        ranges: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[int]] = {}
        for table, owners, n_words in self.classes:
            for begin, i in table.search(data):
                doc = int(np.searchsorted(offsets, begin, "right")) - 1
                word = int(np.searchsorted(starts, begin + 1)) - int(doc_words[doc])
                ranges.setdefault(doc, []).append((word, word + n_words[i]))
                items.setdefault(doc, set()).update(owners[i])
        for doc in range(len(texts)):
            yield int(doc_words[doc + 1] - doc_words[doc]), union(ranges.get(doc, [])), items.get(doc, set())


    def judge_long(self, data: np.ndarray) -> tuple[int, list[tuple[int, int]], set[int]]:
        """As ``judge`` for one long text: piece by piece, each after the last words of the one before."""
        total, ranges, items, held = 0, [], set(), []
        for a, b in pieces(data, _FOLD == 32):
            folded = _FOLD[data[a:b]].tobytes()
            ((n, found, who),) = self.judge(pa.array([b" ".join([*held, folded])], pa.string()))
            base = total - len(held)
            ranges += [(base + x, base + y) for x, y in found]
            items |= who
            total = base + n
            keep = self.longest - 1
            held = [*held, *folded.rsplit(None, keep)[-keep:]][-keep:] if keep else []
        return total, union(ranges), items


def union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SCHEMA = "n_words long, hits array<struct<begin: long, end: long>>, items array<string>"


def find_passages(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, most_items: int = MOST_ITEMS, most_bytes: int = MOST_BYTES, carry: list[str] | None = None
) -> DataFrame:
    """``row`` (the columns of ``docs``, or those in ``carry``), n_words, hits (word ranges inside occurrences), items (ids found, sorted).

    Items are searched for block by block; the blocks' findings are merged row by row, so rows never move.
    """
    stated = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(item_text_col).alias("text"))
    blocks = _blocks(stated, most_items, most_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return append_columns(docs, [F.col(text_col)], _judge(first, docs.sparkSession, window), SCHEMA, carry)
    out = append_columns(docs, [F.col(text_col)], _judge(first, docs.sparkSession, window), SCHEMA)
    for k, block in enumerate(itertools.chain([second], blocks), 1):
        if k % PASSES_AT_ONCE == 0:
            out = cut(out, "passages")
        more = append_columns(out, [F.col(f"row.{text_col}")], _judge(block, docs.sparkSession, window), SCHEMA)
        out = more.select("row.row", "row.n_words", F.concat("row.hits", "hits").alias("hits"), F.concat("row.items", "items").alias("items"))
    row = F.struct(*[F.col(f"row.{c}") for c in carry]).alias("row") if carry else F.col("row")
    return out.select(row, "n_words", merged("hits").alias("hits"), F.array_sort(F.array_distinct("items")).alias("items"))


def merged(hits: str):
    """The union of word ranges, in SQL functions."""
    empty = F.expr("cast(array() as array<struct<begin: bigint, end: bigint>>)")

    def add(out, x):
        last = F.try_element_at(out, F.lit(-1))
        joins = last.isNotNull() & (x["begin"] <= last["end"])
        grown = F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(last["begin"].alias("begin"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when(joins, grown).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(F.array_sort(hits), empty, add)


def _blocks(stated: DataFrame, most_items: int, most_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The stated items, block by block; always one block at least."""
    block: list[tuple[str, str]] = []
    size = 0
    for r in stated.toLocalIterator():
        own = len(r["text"] or "")
        if block and (len(block) >= most_items or size + own > most_bytes):
            yield block
            block, size = [], 0
        block.append((r["id"], r["text"]))
        size += own
    yield block


def _judge(items: list[tuple[str, str]], spark, window: int):
    sent = spark.sparkContext.broadcast(items)  # one block of items, of a stated size
    name = hashlib.sha256(repr(items).encode()).hexdigest()

    def make():
        searchers = claim("decontaminate")
        if name not in searchers:
            searchers.clear()
            searchers[name] = Searcher(windows(sent.value, window))
        searcher, ids = searchers[name], [i for i, _ in sent.value]
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = filled(batch.column(0))
            n_words, hits, found = [], [], []
            for i, j in slices(texts):
                long = long_text(texts, i, j)
                for n, ranges, who in searcher.judge(texts.slice(i, j - i)) if long is None else [searcher.judge_long(long)]:
                    n_words.append(n)
                    hits.append([{"begin": a, "end": b} for a, b in ranges])
                    found.append(sorted({str(ids[k]) for k in who if ids[k] is not None}))
            return [pa.array(n_words, pa.int64()), pa.array(hits, kind), pa.array(found, pa.list_(pa.string()))]

        return step

    return make


def n_hit(hits: str = "hits"):
    return F.aggregate(hits, F.expr("0L"), lambda n, x: n + x["end"] - x["begin"])


def contaminated(hits: str = "hits", n_words: str = "n_words", one_in: int = 20):
    """The contract's rule: some word is hit, and at least one in twenty."""
    return (n_hit(hits) > 0) & (one_in * n_hit(hits) >= F.col(n_words))
