"""Shared parts of the training-data operators: Arrow text buffers, vectorised word hashes, bitmaps of keys.

Every Python function here works on one Arrow batch, or on slices of it of about a MB; a longer text is worked on in pieces
of that size. So a worker's memory does not depend on how many rows or how long a key's group is, and of a long text it
holds the bytes and what the operator keeps of it, not the arrays in between.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docketspark.session import lean, small_batches

SLICE_BYTES = 1 << 20

_CACHES: dict[str, dict] = {}


def worker_cache(name: str) -> dict:
    """What one operator keeps in a Python worker between tasks."""
    return _CACHES.setdefault(name, {})


def claim(name: str) -> dict:
    """The operator's cache; what other operators left in this worker goes, so a worker holds one operator's tables at a time."""
    for other, kept in _CACHES.items():
        if other != name:
            kept.clear()
    return worker_cache(name)

_U = np.uint64
_BASE = pow(0x9E3779B97F4A7C15, 1, 1 << 64) | 5
_BASE_INV = pow(_BASE, -1, 1 << 64)


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, for the operators' texts; the catalogue's other queries set the session's own again."""
    small_batches(spark)


def filled(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The texts as one plain string array, null as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts take at most ``most`` bytes together; a longer text has a range of its own."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) if len(texts) else np.zeros(0, np.int64)
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield start, stop
        start = stop


def long_text(texts: pa.Array, i: int, j: int, most: int = SLICE_BYTES) -> np.ndarray | None:
    """The bytes of row ``i`` if it is a range of its own that is longer than ``most``: a text to be worked on in pieces."""
    if j - i != 1:
        return None
    raw = texts[i].as_buffer()
    return np.frombuffer(raw, np.uint8) if len(raw) > most else None


def pieces(data: np.ndarray, breaks: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of one text's bytes of at most ``most``, each but the last ending behind a byte that ``breaks`` (a table of 256)
    marks. Only a run without such a byte makes a longer range."""
    start, n = 0, len(data)
    while start < n:
        stop = min(start + most, n)
        if stop < n:
            at = np.flatnonzero(breaks[data[start:stop]])
            while not len(at) and stop < n:
                before, stop = stop, min(stop + most, n)
                at = np.flatnonzero(breaks[data[before:stop]])[:1] + (before - start)
            stop = start + int(at[-1]) + 1 if len(at) else n
        yield start, stop
        start = stop


def ended_buffer(texts: pa.Array, end: str = "\n") -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, each followed by ``end``, and the offset at which each text begins (one more at the end)."""
    joined = pc.binary_join_element_wise(texts, pa.scalar(""), pa.scalar(end))
    offsets = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset : joined.offset + len(joined) + 1].astype(np.int64)
    data = np.frombuffer(joined.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(joined) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x + _U((seed * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


POWER_BLOCK = 1 << 18


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse for one block: 4 MB, however long texts are."""
    out = []
    for base in (_BASE, _BASE_INV):
        steps = np.full(POWER_BLOCK + 1, base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def word_spans(separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without a separator; the buffer must end with one."""
    edge = np.diff(separator.view(np.int8), prepend=np.int8(1))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``data``, from prefix sums over blocks of the buffer and not word by word."""
    up, down = _powers()
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = int(np.searchsorted(ends, base + POWER_BLOCK, "right"))
        if j > i:
            block = data[base : ends[j - 1]]
            sums = np.zeros(len(block) + 1, np.uint64)
            np.cumsum((block.astype(np.uint64) + _U(1)) * up[: len(block)], out=sums[1:])
            first, last = starts[i:j] - base, ends[i:j] - base
            out[i:j] = (sums[last] - sums[first]) * down[first]
            i = j
            continue
        total, scale, step = 0, 1, pow(_BASE, POWER_BLOCK, 1 << 64)  # one span that is longer than a block
        for p in range(base, int(ends[i]), POWER_BLOCK):
            block = data[p : min(p + POWER_BLOCK, int(ends[i]))].astype(np.uint64) + _U(1)
            total += scale * int((block * up[: len(block)]).sum(dtype=np.uint64))
            scale = scale * step & 0xFFFFFFFFFFFFFFFF
        out[i] = total & 0xFFFFFFFFFFFFFFFF
        i += 1
    return mix(out + (ends - starts).astype(np.uint64)) if len(starts) else out


def append_columns(df: DataFrame, inputs: list[Column], make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], schema: str, carry: list[str] | None = None) -> DataFrame:
    """``row`` (the columns of ``df``, or those named in ``carry``, in a struct, so no name can clash) beside new columns.

    ``make`` runs once per task; its function gets batches of ``inputs`` and returns the arrays of ``schema``.
    """
    packed = df.select(F.struct(*(carry or ["*"])).alias("row"), *[c.alias(f"_{i}") for i, c in enumerate(inputs)])
    out = StructType([packed.schema["row"], *StructType.fromDDL(schema).fields])
    names = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *step(batch.select(range(1, batch.num_columns)))], names=names)

    return packed.mapInArrow(lean(run), out)


# --- bitmaps of keys: bits in proportion to the keys up to a stated bound, so what is embedded in a plan is bounded

LEAST_LOG2_BITS, MOST_LOG2_BITS = 16, 26


def bits_for(n_keys: int, per_key: int = 16) -> int:
    """The logarithm of a bitmap's size: ``per_key`` bits a key, at most 8 MB. Beyond that more keys pass that are not in it."""
    return max(LEAST_LOG2_BITS, min(MOST_LOG2_BITS, math.ceil(math.log2(max(1, n_keys * per_key)))))


def bit_of(key: Column, log2_bits: int) -> Column:
    """The bit of a 64-bit key in a bitmap of ``2**log2_bits`` bits."""
    return F.shiftrightunsigned(key, 64 - log2_bits)


def bitmap(keys: DataFrame, key: Column, log2_bits: int) -> DataFrame:
    """One row with ``bits array<long>``: the bits of all keys, built by partial aggregation.

    At most ``2**log2_bits / 64`` words reach the last task, whatever the number of keys.
    """
    words = (1 << log2_bits) // 64
    bits = keys.select(bit_of(key, log2_bits).alias("bit")).select(
        F.shiftrightunsigned("bit", 6).alias("word"), F.call_function("shiftleft", F.expr("1L"), F.col("bit").bitwiseAND(F.lit(63)).cast("int")).alias("value")
    )
    every = keys.sparkSession.range(words).select(F.col("id").alias("word"), F.expr("0L").alias("value"))
    merged = bits.unionByName(every).groupBy("word").agg(F.bit_or("value").alias("value"))
    return merged.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "value"))), lambda x: x["value"]).alias("bits"))


def in_bitmap(bits: Column, key: Column, log2_bits: int) -> Column:
    """True if the key's bit is set; false positives occur, false negatives do not."""
    bit = bit_of(key, log2_bits)
    word = F.get(bits, F.shiftrightunsigned(bit, 6).cast("int"))
    return F.call_function("shiftrightunsigned", word, bit.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
