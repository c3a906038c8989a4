"""Whole numbers packed into as few bytes as they need, seven bits a byte, for arrays at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binaries of runs of ``counts`` values each. Values are not negative."""
    values = values.astype(np.uint64)
    width = np.ones(len(values), np.int64)
    rest = values >> np.uint64(7)
    while rest.any():
        width += rest > 0
        rest >>= np.uint64(7)
    begins = np.zeros(len(values) + 1, np.int64)
    np.cumsum(width, out=begins[1:])
    out = np.empty(int(begins[-1]), np.uint8)
    for k in range(int(width.max(initial=0))):
        own = np.flatnonzero(width > k)
        byte = (values[own] >> np.uint64(7 * k)).astype(np.uint8) & np.uint8(127)
        out[begins[own] + k] = byte | np.where(width[own] > k + 1, 128, 0).astype(np.uint8)
    ends = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=ends[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(begins[ends]), pa.py_buffer(out)]).cast(pa.binary())


def unpack(column: pa.Array) -> np.ndarray:
    """All values of the binaries, one after the other."""
    column = column.cast(pa.large_binary())
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.int64)
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    width = last - first + 1
    out = np.zeros(len(last), np.uint64)
    for k in range(int(width.max(initial=0))):
        own = width > k
        out[own] |= (data[first[own] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return out.astype(np.int64)


def zigzag(values: np.ndarray) -> np.ndarray:
    """Signed numbers as unsigned ones, small where they are near zero."""
    values = values.astype(np.int64)
    return ((values << 1) ^ (values >> 63)).view(np.uint64)


def unzigzag(values: np.ndarray) -> np.ndarray:
    values = values.view(np.uint64)
    return (values >> np.uint64(1)).view(np.int64) ^ -(values & np.uint64(1)).view(np.int64)


def runs(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run begins, and of each value the number of its run."""
    begins = np.cumsum(counts) - counts
    return begins, np.repeat(np.arange(len(counts)), counts)


def deltas(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each value less the one before in its run; the first as it is."""
    out = np.diff(values, prepend=0)
    begins = runs(counts)[0]
    begins = begins[counts > 0]
    out[begins] = values[begins]
    return out


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The way back from ``deltas``."""
    total = np.cumsum(values)
    begins, run = runs(counts)
    before = np.where(begins > 0, total[np.maximum(begins - 1, 0)], 0) if len(values) else begins
    return total - before[run]
