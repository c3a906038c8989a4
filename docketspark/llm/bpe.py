"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last 16 bytes cuts every text where the hash says so, so equal passages are cut alike wherever
they stand. A worker encodes a chunk the first time it meets it and keeps the result in a store of bounded size; copies
and shared passages cost a look-up. Joins are repaired until there is exact agreement: what a cut has severed, the end of
one chunk up to its last white space and the start of the next up to its first, is put together and encoded again, growing
over chunks without white space. The repaired join is then encoded once more together with the words on its two sides, and
must give those words' ids and its own. Where it does not, the window grows to twice as many words on each side, at last
to the whole text, until both sides agree.

Inside a chunk words are looked up in a bounded store of words, so new chunks cost as much as their new words. The tokenizer
has to drop white space; one that keeps it is refused.

Defined cases: null text is empty and has no tokens; a text without white space is one word whatever its length; a long text
is encoded in pieces of 256 KB cut at white space, with the joins of pieces checked like those of chunks; repeated rows are
encoded each; an empty table gives no rows; all columns of the table come back in ``row`` untouched.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketspark.llm.common import append_columns, claim, ended_buffer, filled, long_text, mix, pieces, slices

WINDOW = 16
LEAST_CHUNK = 256
MARKS = ".,;:!?"
_MARKED = re.compile(rb"([0-9A-Za-z])([.,;:!?])(?=[\x20\t-\r]|\Z)")
_FIRST = re.compile(rb"[^\x20\t-\r]*")
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
MASK = np.uint32(0x3FF << 22)  # a cut about every 1,024 bytes
MOST_WORDS, LONGEST_WORD = 200_000, 64
SLICE_BYTES = 1 << 18  # spelling takes some 50 bytes of memory for each
STORE_BYTES = 8 << 20
MOST_AGREED = 100_000
HASHED_IDS = 1 << 16

_GEAR = (mix(np.arange(256, dtype=np.uint64), 7) >> np.uint64(32)).astype(np.uint32)


def cuts(data: np.ndarray) -> np.ndarray:
    """Positions before which the rolling hash cuts, at character starts only."""
    if len(data) <= WINDOW:
        return np.zeros(0, np.int64)
    h = _GEAR[data]
    for k in (1, 2, 4, 8):
        h[k:] += h[:-k] << np.uint32(k)
    at = np.flatnonzero((h & MASK) == 0) + 1
    at = at[(at < len(data))]
    return at[(data[at] & 0xC0) != 0x80]


class Store(dict):
    """A store that keeps at most two generations of ``most`` bytes each; what is used moves to the young one."""

    def __init__(self, most: int = STORE_BYTES):
        super().__init__()
        self.most, self.old, self.bytes = most, {}, 0

    def find(self, key: bytes):
        found = self.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.keep(key, found)
        return found

    def keep(self, key: bytes, value) -> None:
        if self.bytes > self.most:
            self.old = dict(self)
            self.clear()
            self.bytes = 0
        self[key] = value
        self.bytes += 4 * len(key) + 400


class Coder:
    """Encodes whole texts to ids (packed four-byte integers) and spells ids out. One a worker."""

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        gc.set_threshold(1_000_000, 50, 1000)  # the stores hold no cycles, and scanning them again and again is dear
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        if not self._agrees("ab \n cd", "ab cd"):
            raise ValueError("chunks are joined at white space, which this tokenizer does not drop")
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.joins_only = self.tokenizer.decoder is None  # then decoding joins the tokens with spaces
        self.ends = np.array([bool(suffix) and t.endswith(suffix) for t in tokens])
        # a text without "<|" holds no special token; there case and a sign at a word's end can be set apart at once
        marked = all(t.startswith("<|") for t in special)
        self.folds_case = marked and self._agrees("Ab Zz", "ab zz")
        self.parts_marks = marked and all(self._agrees(f"ab{m} 7{m}", f"ab {m} 7 {m}") for m in MARKS)
        self.decimal_table = _spelling([str(i).encode() for i in range(size)])
        self.token_table = _spelling([t.encode() for t in tokens])
        self.words: dict[bytes, bytes] = {}
        self.store = Store()
        self.agreed: dict[tuple, bool] = {}
        self.encoded = self.reused = self.grown = 0  # chunks encoded, chunks found, joins that had to grow

    def _agrees(self, a: str, b: str) -> bool:
        return self.tokenizer.encode(a, add_special_tokens=False).ids == self.tokenizer.encode(b, add_special_tokens=False).ids

    # -- words

    def _split(self, part: bytes) -> list[bytes]:
        """Words that are encoded each on its own; ``part`` begins and ends at white space or a text's edge."""
        if b"<|" not in part:
            if self.parts_marks:
                part = _MARKED.sub(rb"\1 \2", part)
            if self.folds_case:
                part = part.lower()
        return part.split()

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        out = self._encode_letters([w for w in words if w.isalpha() or (len(w) <= LONGEST_WORD and w.decode().isalpha())])
        rest = [w for w in words if w not in out]
        for w, e in zip(rest, self.batch([w.decode() for w in rest], add_special_tokens=False), strict=True):
            out[w] = np.array(e.ids, np.uint32).tobytes()
        return out

    def _encode_letters(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Words of letters only, encoded in one go: each has one token that ends a word, unless normalisation breaks it up."""
        if len(words) < 2:
            return {}
        ids = np.array(self.tokenizer.encode(b" ".join(words).decode(), add_special_tokens=False).ids, np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            return {}
        raw, stops = ids.tobytes(), (4 * ends).tolist()
        return {w: raw[a:b] for w, a, b in zip(words, [0, *stops], stops, strict=False)}

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words not met before; all but very long ones are kept, in a store of bounded size."""
        new = self._encode(words)
        if len(self.words) > MOST_WORDS:
            self.words.clear()
        self.words.update(new if max(map(len, new), default=0) <= LONGEST_WORD else {w: p for w, p in new.items() if len(w) <= LONGEST_WORD})
        return new

    def _joined(self, words: list[bytes], found: list, learned: dict[bytes, bytes]) -> bytes:
        return b"".join([learned[w] if p is None else p for w, p in zip(words, found, strict=True)] if None in found else found)

    # -- chunks

    @staticmethod
    def _parts(chunk: bytes) -> tuple[bytes, bytes | None, bytes]:
        """What stands before a chunk's first white space, between, and after its last; (chunk, None, b"") without any."""
        first, last = _FIRST.match(chunk).end(), len(chunk) - _FIRST.match(chunk[::-1]).end()
        return (chunk, None, b"") if first == len(chunk) else (chunk[:first], chunk[first:last], chunk[last:])

    def _chunks(self, chunks: list[bytes]) -> dict[bytes, tuple]:
        """(head, ids between, tail, first word between, last one) of each chunk: from the store, or encoded once and stored."""
        out, new = {}, {}
        get = self.words.get
        missing: dict[bytes, None] = {}
        for c in chunks:
            if c in out or c in new:
                self.reused += 1
            elif (found := self.store.find(c)) is not None:
                out[c] = found
                self.reused += 1
            else:
                head, between, tail = self._parts(c)
                words = self._split(between) if between else []
                found = list(map(get, words))
                if None in found:
                    missing.update(dict.fromkeys(w for w, p in zip(words, found, strict=True) if p is None))
                new[c] = (head, words if between is not None else None, tail, found)
        learned = self._learn(list(missing)) if missing else {}
        for c, (head, words, tail, found) in new.items():
            ends = (words[0], words[-1]) if words else (b"", b"")
            out[c] = (head, None if words is None else self._joined(words, found, learned), tail, *ends)
            self.store.keep(c, out[c])
        self.encoded += len(new)
        return out

    # -- joins

    def _ids(self, part: bytes) -> bytes:
        """Packed ids as the library gives them, without any store."""
        return np.array(self.tokenizer.encode(part.decode(), add_special_tokens=False).ids, np.uint32).tobytes()

    def _check(self, joins: list[tuple[bytes, bytes, bytes]]) -> None:
        """Whether each join (word before, what is between, word after), encoded as one, gives its three parts' ids."""
        if len(self.agreed) > MOST_AGREED:
            self.agreed.clear()
        new = [j for j in dict.fromkeys(joins) if j not in self.agreed]
        whole = self.batch([b" ".join(j).decode() for j in new], add_special_tokens=False)
        for j, e in zip(new, whole, strict=True):
            parts = b"".join([self.words.get(w) or self._ids(w) for part in j for w in self._split(part)])
            self.agreed[j] = np.array(e.ids, np.uint32).tobytes() == parts

    def _grow(self, text: bytes) -> bytes:
        """Ids of a text of which some join did not agree: windows of twice as many words, until both sides agree."""
        self.grown += 1
        words = text.split()
        size = 4
        while size < len(words):
            windows = [b" ".join(words[k : k + size]) for k in range(0, len(words), size)]
            own = [self._ids(w) for w in windows]
            if all(self._ids(a + b" " + b) == x + y for a, b, x, y in zip(windows, windows[1:], own, own[1:], strict=False)):
                return b"".join(own)
            size *= 2
        return self._ids(text)

    def slices(self, texts: pa.Array) -> Iterator[list[bytes]]:
        """Packed ids of the texts, some texts at a time."""
        for i, j in slices(texts, SLICE_BYTES):
            if (long := long_text(texts, i, j, SLICE_BYTES)) is None:
                yield self._slice(texts.slice(i, j - i))
            else:
                yield [self._long(long)]

    def _long(self, data: np.ndarray) -> bytes:
        """A long text's ids, from pieces that end at white space."""
        cut_up = [data[a:b].tobytes() for a, b in pieces(data, _SPACE, SLICE_BYTES)]
        edges = [(a.split()[-1:], b.split()[:1]) for a, b in zip(cut_up, cut_up[1:], strict=False)]
        joins = [(a[0], b"", b[0]) for a, b in edges if a and b]
        self._check(joins)
        if not all(self.agreed[j] for j in joins):
            return self._grow(data.tobytes())
        return b"".join([p for piece in cut_up for p in self._slice(pa.array([piece], pa.string()))])

    def _slice(self, texts: pa.Array) -> list[bytes]:
        data, offsets = ended_buffer(texts)
        at = cuts(data)
        raw = data.tobytes()
        chunked = []
        for start, end in zip(offsets[:-1].tolist(), (offsets[1:] - 1).tolist(), strict=True):
            own, begin = [], start
            for cut in [*at[np.searchsorted(at, start + WINDOW) : np.searchsorted(at, end)].tolist(), end]:
                if cut - begin >= LEAST_CHUNK or cut == end:
                    own.append(raw[begin:cut])
                    begin = cut
            chunked.append(own)
        encoded = self._chunks([c for own in chunked for c in own])
        # joins: what lies between the inner parts of two chunks, from white space to white space, is encoded again
        texts_parts: list[list] = []
        joins: list[bytes] = []
        sides: list[list[tuple[bytes, bytes, bytes]]] = []  # of each text, its joins with the words on both sides
        for own in chunked:
            parts, carry, before, own_sides = [], b"", b"", []
            for c in own:
                head, between, tail, first, last = encoded[c]
                carry += head
                if between is not None:
                    parts += [carry, between]
                    joins.append(carry)
                    if before and first:
                        own_sides.append((before, carry, first))
                    carry, before = tail, last or carry or before
            parts.append(carry)
            joins.append(carry)
            if before and carry:
                own_sides.append((before, carry, b""))
            texts_parts.append(parts)
            sides.append(own_sides)
        split = {c: self._split(c) for c in dict.fromkeys(joins)}
        repaired: dict[bytes, bytes] = {w: self.words.get(w) for words in split.values() for w in words}
        if missing := [w for w, p in repaired.items() if p is None]:
            repaired |= self._learn(missing)
        again = {c: b"".join([repaired[w] for w in words]) for c, words in split.items()}
        self._check([s for own in sides for s in own])
        out = [b"".join([p if k & 1 else again[p] for k, p in enumerate(parts)]) for parts in texts_parts]
        for k, own in enumerate(sides):
            if not all(self.agreed.get(s, True) for s in own):
                out[k] = self._grow(raw[offsets[k] : offsets[k + 1] - 1])
        return out

    # -- spelling

    def spelled(self, packed: list[bytes], table: tuple) -> list[memoryview]:
        """The ids of each text written with ``table``'s strings, one space between."""
        starts, lengths, letters = table
        ids = np.frombuffer(b"".join(packed), np.uint32)
        own = lengths[ids]
        ends = np.cumsum(own, dtype=np.int64)
        at = np.repeat(starts[ids] - (ends - own), own)
        at += np.arange(len(at))
        out = memoryview(letters[at].tobytes())
        bounds = np.concatenate([[0], ends])[np.cumsum([0, *(len(p) // 4 for p in packed)])].tolist()
        return [out[a : max(a, b - 1)] for a, b in zip(bounds, bounds[1:], strict=False)]

    def digests(self, packed: list[bytes], table: tuple) -> list[str]:
        """SHA-256 of each text's spelling; of a long one, part by part."""
        if sum(map(len, packed)) <= 4 * HASHED_IDS or len(packed) > 1:
            return [hashlib.sha256(x).hexdigest() for x in self.spelled(packed, table)]
        sha = hashlib.sha256()
        for k in range(0, len(packed[0]), 4 * HASHED_IDS):
            sha.update(b" " * (k > 0))
            sha.update(self.spelled([packed[0][k : k + 4 * HASHED_IDS]], table)[0])
        return [sha.hexdigest()]

    def decoded(self, packed: list[bytes]) -> list[bytes | memoryview]:
        if self.joins_only:
            return self.spelled(packed, self.token_table)
        return [self.tokenizer.decode(np.frombuffer(p, np.uint32).tolist(), skip_special_tokens=False).encode() for p in packed]


def _spelling(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each string, a space after it, begins in one buffer; its length; the buffer."""
    lengths = np.array([len(x) + 1 for x in strings], np.int64)
    return np.cumsum(lengths) - lengths, lengths, np.frombuffer(b" ".join(strings) + b" ", np.uint8)


def coder_for(tokenizer: str) -> Coder:
    """One coder a worker, so its stores outlive a task."""
    coders = claim("bpe")
    key = hash(tokenizer)
    if key not in coders:
        coders.clear()
        coders[key] = Coder(tokenizer)
    return coders[key]


#: What the operator can give for a text: type, and how it is had from (coder, packed ids of some texts).
OUTPUTS = {
    "n_tokens": ("long", lambda c, ps: pa.array([len(p) // 4 for p in ps], pa.int64())),
    "ids": ("array<int>", lambda c, ps: pa.array([np.frombuffer(p, np.int32) for p in ps], pa.list_(pa.int32()))),
    "decoded": ("string", lambda c, ps: pa.array([bytes(x).decode() for x in c.decoded(ps)], pa.string())),
    "ids_sha256": ("string", lambda c, ps: pa.array(c.digests(ps, c.decimal_table), pa.string())),
    "decoded_sha256": ("string", lambda c, ps: pa.array(c.digests(ps, c.token_table) if c.joins_only else [hashlib.sha256(x).hexdigest() for x in c.decoded(ps)], pa.string())),
}


def encode(docs: DataFrame, tokenizer_path: str, outputs: tuple[str, ...] = ("n_tokens", "ids"), text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row`` (the columns of ``docs``, or those in ``carry``) and the asked ``OUTPUTS`` of every whole text.

    The tokenizer's file is read on the driver and broadcast; its size is fixed and does not depend on the data.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        coder = coder_for(sent.value)

        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            columns: list[list[pa.Array]] = [[] for _ in outputs]
            for packed in coder.slices(filled(batch.column(0))):
                for column, name in zip(columns, outputs, strict=True):
                    column.append(OUTPUTS[name][1](coder, packed))
            return [pa.concat_arrays(c) if c else pa.array([], "int64" if OUTPUTS[n][0] == "long" else pa.string()) for c, n in zip(columns, outputs, strict=True)]

        return step

    return append_columns(docs, [F.col(text_col)], make, ", ".join(f"{n} {OUTPUTS[n][0]}" for n in outputs), carry)
