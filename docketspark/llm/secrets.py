"""Secret scan: fixed patterns, and a token-efficiency test for random strings that no pattern names.

A string of letters and digits that a tokenizer breaks into many pieces for its length has no words in it. Runs of
``[A-Za-z0-9+/_-]`` of 20 signs and more that hold letters are encoded with a tiktoken vocabulary, and those with fewer
than ``most_ratio`` characters a token are reported as ``random``, unless they are known digests (hex of the length of
MD5, SHA-1, SHA-256 or SHA-512, UUIDs) or identifiers: words or numbers joined by ``_``, ``-``, ``/``, ``+`` or by
capitals, where most letters are in words of three letters and more that reach ``most_ratio`` by themselves. Runs without
a letter are numbers. Spans of the patterns stay whatever the test says; a run that overlaps one is not reported again.

Defined cases: null text is empty and has no spans; spans are in code points, end exclusive; spans that begin together are
in the order of ``KINDS``; texts and runs of any length are scanned whole, and a text's runs are told from its spans by a search
in their order, so time grows as the text does; repeated rows are scanned each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketspark.llm.common import claim, filled, lean

# fixed values: the patterns of the contract; ASCII letters only are matched in either case
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_RUN = 6, 20, 20

RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}|[0-9a-fA-F]{128}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})")
PIECE = re.compile(r"[A-Za-z0-9]+")
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

MOST_RATIO = 2.2
LEAST_WORD, WORD_SHARE = 3, 0.75


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and non-overlapping within a kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=_order)


def _order(span: tuple[int, int, str]) -> tuple[int, int]:
    return span[0], KINDS.index(span[2])


def candidate_runs(text: str) -> list[tuple[int, int]]:
    """Runs that could be random strings: with a letter, no known digest."""
    return [m.span() for m in RUN.finditer(text) if WORD.search(m[0]) and not DIGEST.fullmatch(m[0])]


def is_identifier(run: str, count_tokens, most_ratio: float = MOST_RATIO) -> bool:
    """Whether most letters are in words. Codes of two letters between joining signs (``en/fr``) say nothing either way."""
    letters = in_words = 0
    for piece in PIECE.findall(run):
        if len(piece) < LEAST_WORD and piece.isalpha():
            continue
        for word in WORD.findall(piece):
            letters += len(word)
            if len(word) >= LEAST_WORD and len(word) >= most_ratio * count_tokens(word):
                in_words += len(word)
    return in_words >= WORD_SHARE * letters


def random_spans(text: str, base: list[tuple[int, int, str]], count_tokens, most_ratio: float = MOST_RATIO, runs: list[tuple[int, int]] | None = None) -> list[tuple[int, int, str]]:
    """The runs that no span of ``base`` (in order of starts) overlaps and that have too few characters a token."""
    starts = [s for s, _, _ in base]
    reach = list(itertools.accumulate((e for _, e, _ in base), max))  # the furthest end so far

    def free(start: int, end: int) -> bool:
        before = bisect.bisect_left(starts, end)
        return not before or reach[before - 1] <= start

    return [
        (start, end, "random")
        for start, end in (candidate_runs(text) if runs is None else runs)
        if free(start, end) and (end - start) < most_ratio * count_tokens(text[start:end]) and not is_identifier(text[start:end], count_tokens, most_ratio)
    ]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def token_counter(vocabulary: bytes, pattern: str):
    """Counts tokens under a tiktoken vocabulary file's contents."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    coder = tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda run: len(coder.encode_ordinary(run))


def scan_secrets(docs: DataFrame, vocabulary: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", most_ratio: float = MOST_RATIO) -> DataFrame:
    """Per document: id, spans array<struct<start, end, kind>>. ``vocabulary`` is the tokenizer's file, of fixed size."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = claim("secrets")  # the vocabulary is built once a worker
        key = (hash(sent.value), pattern)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in batches:
            out = []
            for text in filled(batch.column("text")).to_pylist():
                spans = base_spans(text)
                if runs := candidate_runs(text):
                    if key not in kept:
                        kept.clear()
                        kept[key] = token_counter(sent.value, pattern)
                    spans = sorted(spans + random_spans(text, spans, kept[key], most_ratio, runs), key=_order)
                out.append([{"start": s, "end": e, "kind": k} for s, e, k in spans])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, kind)], names=["id", "spans"])

    return rows.mapInArrow(lean(run), f"id {id_type}, spans array<struct<start: long, end: long, kind: string>>")


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
