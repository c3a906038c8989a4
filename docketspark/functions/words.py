"""Words of Arrow text columns as arrays: runs of a-z and 0-9 in lower-cased text, a slice of some MB at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21

_BETWEEN = np.ones(256, bool)
_BETWEEN[48:58] = _BETWEEN[97:123] = False


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts take at most ``most`` bytes together; a longer text has a range of its own."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield start, stop
        start = stop


def spelled(data: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Where the words of a buffer begin, and the words. The buffer must end with a byte between words."""
    between = _BETWEEN[data]
    edge = np.diff(between.view(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    return starts, pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[~between])])


def _pieces(data: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """One long text in parts that end between words; only a longer word makes a longer part."""
    start = 0
    while start < len(data):
        stop = start + most
        while stop < len(data) and not _BETWEEN[data[stop - 1]]:
            gap = np.flatnonzero(_BETWEEN[data[stop : stop + most]])
            stop = stop + int(gap[0]) + 1 if len(gap) else stop + most
        yield data[start:stop]
        start = stop


class Occurrences:
    """The words of some texts: for every distinct pair of text and term, in order, the positions at which it stands."""

    def __init__(self, doc: np.ndarray, code: np.ndarray, place: np.ndarray, terms: list[str], sizes: np.ndarray):
        kept = code >= 0
        doc, code, place = doc[kept], code[kept], place[kept]
        key = doc * max(1, len(terms)) + code
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.doc, self.code = doc[order][first], code[order][first]
        self.offsets = np.append(first, len(key)).astype(np.int32)
        self.places, self.terms, self.sizes = place[order].astype(np.int32), terms, sizes

    def term(self) -> pa.Array:
        return pa.DictionaryArray.from_arrays(pa.array(self.code, pa.int32()), pa.array(self.terms, pa.string())).cast(pa.string())

    def positions(self) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(self.offsets), pa.array(self.places))


def encoded(texts: pa.Array, most: int | None = None) -> Iterator[tuple[int, list[pa.DictionaryArray], np.ndarray]]:
    """For slices of ``texts`` (lower-cased, no nulls) of at most ``most`` bytes the first row, all words in order and the number of words of each row. Words are
    parts with a dictionary each; a text longer than a slice is in several, so what is held beside them does not grow with it."""
    for i, j in slices(texts, most or SLICE_BYTES):
        raw = texts[i].as_buffer() if j - i == 1 else b""
        if len(raw) > SLICE_BYTES:
            parts = [spelled(np.append(part, np.uint8(10)))[1].dictionary_encode() for part in _pieces(np.frombuffer(raw, np.uint8), SLICE_BYTES)]
            yield i, parts, np.array([sum(map(len, parts))])
        else:
            joined = pc.binary_join_element_wise(texts.slice(i, j - i), pa.scalar(""), pa.scalar("\n"))
            offsets = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset : joined.offset + len(joined) + 1].astype(np.int64)
            starts, words = spelled(np.frombuffer(joined.buffers()[2], np.uint8)[offsets[0] : offsets[-1]])
            yield i, [words.dictionary_encode()], np.diff(np.searchsorted(starts, offsets - offsets[0]))


def numbered(parts: list[pa.DictionaryArray], term_of: Callable[[str], str | None] | None = None) -> tuple[np.ndarray, pa.Array]:
    """Of every word of ``parts`` the number of its term, -1 where ``term_of`` leaves it out, and the terms; each different word is asked for once."""
    whole = pa.chunked_array(parts, pa.dictionary(pa.int32(), pa.string())).unify_dictionaries()
    code = np.concatenate([part.indices.to_numpy() for part in whole.chunks] or [np.zeros(0, np.int32)])
    words = whole.chunk(0).dictionary if whole.num_chunks else pa.array([], pa.string())
    if term_of is None:
        return code, words
    terms = pa.array([term_of(word) for word in words.to_pylist()], pa.string()).dictionary_encode()
    return pc.fill_null(terms.indices, -1).to_numpy()[code], terms.dictionary


def occurrences(texts: pa.Array, term_of: Callable[[str], str | None] | None = None, most: int | None = None) -> Iterator[tuple[int, Occurrences]]:
    """For slices of ``texts`` (lower-cased, no nulls) of at most ``most`` bytes the first row and the occurrences. ``term_of``: a word's term, null to leave it out;
    left out words count in positions and sizes."""
    for i, parts, sizes in encoded(texts, most):
        code, terms = numbered(parts, term_of)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        yield i, Occurrences(doc, code, np.arange(len(code)) - (np.cumsum(sizes) - sizes)[doc], terms.to_pylist(), sizes)
