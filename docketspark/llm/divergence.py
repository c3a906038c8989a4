"""Source divergence audit: how far each source's use of words lies from the other sources' and from its language's.

1. One scan of the texts counts terms: the words of a slice become integers by dictionary encoding, (group, term) pairs are
   counted, and each task adds its slices up, at most ``PENDING`` rows at a time. Spark adds the tasks' partial counts up
   by (language, source, term), so a hot source or word is summed before and after the shuffle, never collected.
2. A language keeps the terms that enough of its documents have. Kept terms are sorted by language and UTF-8 bytes over all
   partitions and cut into chunks; what is broadcast is each chunk's first term, and only below ``MOST_SENT`` bytes:
   above, the chunks' numbers are joined to the terms.
3. A task holds one chunk at a time: its sorted array of kept terms, their ids by ``searchsorted``, and one dense vector of
   counts a source by ``bincount``. Ids follow UTF-8 order, so the dense vectors of all sources line up, distances are
   differences of arrays, and a stable sort by value leaves ties in the order of the terms.
4. Distances of sources are added up over a task's chunks before they move; of terms each chunk sends on its ``most_terms``
   best of a source.

A chunk has at most ``CHUNK`` terms, fewer if a language has many sources, so a task's memory is bounded by ``CELLS`` and by
the square of the sources of one language, which is the size of the result.

Arithmetic is exact: shares are floors of quotients of integers, by long division in base 1,000, for counts up to 10**15.

Defined cases: null text, language or source is the empty string; a text without terms still makes its group occur; a language
in which no term is kept gives its pairs the value 0 and has no ``term`` rows; repeated rows count each; texts of any length
are read whole, in pieces of 1 MB; a group without another source in its language has no ``pair`` rows; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketspark.llm.common import ended_buffer, filled, lean, long_text, pieces, slices, word_spans
from docketspark.session import cut

PENDING = 200_000
CHUNK = 1024
CELLS = 1 << 20
MOST_SENT = 4 << 20

_OTHER = np.zeros(256, bool)
_OTHER[:65] = _OTHER[91:97] = _OTHER[123:128] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms_of(data: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Starts and lower-cased terms of a buffer that ends with a byte between terms."""
    data = _LOWER[data]
    other = _OTHER[data]
    starts, ends = word_spans(other)
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    letters = data[~other]
    return starts, pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])


def _pairs(texts: pa.Array, i: int, j: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Document and term number of every word of a slice, and the terms; a long text's pieces one by one."""
    data = long_text(texts, i, j)
    if data is None:
        data, offsets = ended_buffer(texts.slice(i, j - i))
        starts, words = terms_of(data)
        coded = words.dictionary_encode()
        yield np.searchsorted(offsets, starts, "right") - 1, coded.indices.to_numpy(), coded.dictionary
        return
    for a, b in pieces(data, _OTHER):
        coded = terms_of(np.append(data[a:b], np.uint8(10)))[1].dictionary_encode()
        yield np.zeros(len(coded), np.int64), coded.indices.to_numpy(), coded.dictionary


def _slice_counts(langs: pa.Array, sources: pa.Array, texts: pa.Array, i: int, j: int) -> pa.Table:
    """(lang, source, term, n, df) of the documents i to j."""
    seen: dict[str, np.ndarray] = {}
    tables = []
    for doc, term, names in _pairs(texts, i, j):
        each, n = np.unique(doc * len(names) + term, return_counts=True)
        at, term = np.divmod(each, max(1, len(names)))
        df = np.ones(len(each), np.int64)
        if j - i == 1:  # a term of several pieces of one text is in one document
            known = seen.setdefault("terms", set())
            df[:] = [t not in known and not known.add(t) for t in names.take(pa.array(term)).to_pylist()]
        tables.append(pa.table([langs.slice(i, j - i).take(pa.array(at)), sources.slice(i, j - i).take(pa.array(at)), names.take(pa.array(term)), pa.array(n, pa.int64()), pa.array(df)], names=["lang", "source", "term", "n", "df"]))
    return _summed(pa.concat_tables(tables))


def _summed(rows: pa.Table) -> pa.Table:
    out = rows.group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("df", "sum")])
    return out.select(["lang", "source", "term", "n_sum", "df_sum"]).rename_columns(["lang", "source", "term", "n", "df"])


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): occurrences and documents of every term in every group. ``docs``: lang, source, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        n_held = least = 0
        for batch in batches:
            langs, sources, texts = (filled(batch.column(c)) for c in ("lang", "source", "text"))
            for i, j in slices(texts):
                held.append(_slice_counts(langs, sources, texts, i, j))
                n_held += held[-1].num_rows
                if n_held < least + PENDING:
                    continue
                held = [_summed(pa.concat_tables(held))]
                n_held = least = held[0].num_rows
                if n_held >= PENDING:
                    yield from held[0].to_batches(max_chunksize=20_000)
                    held, n_held, least = [], 0, 0
        if held:
            yield from _summed(pa.concat_tables(held)).to_batches(max_chunksize=20_000)

    partial = docs.select("lang", "source", "text").mapInArrow(lean(run), "lang string, source string, term string, n long, df long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def chunked(kept: DataFrame, sizes: dict[str, int] | None = None) -> DataFrame:
    """(lang, term, chunk) of the kept terms (lang, term, width): chunks are runs of ``width`` terms of a language in UTF-8 order.

    Partitions hold ranges of the order, and a chunk ends where its partition does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, first, n = None, "", 0
        for batch in batches:
            out = []
            for own, term, width in zip(*(batch.column(c).to_pylist() for c in ("lang", "term", "width")), strict=True):
                if own != lang or n >= width:
                    lang, first, n = own, term, 0
                n += 1
                out.append(first)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("term"), pa.array(out, pa.string())], names=["lang", "term", "chunk"])

    ordered = kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    return ordered.select("lang", "term", "width").mapInArrow(lean(run), "lang string, term string, chunk string")


def share(count: np.ndarray, total: np.ndarray | int, scale_steps: int = 3) -> np.ndarray:
    """floor(1000**scale_steps * count / total), exactly, where count <= total < 2**53."""
    out = np.zeros(np.broadcast(count, total).shape, np.int64)
    rest = np.broadcast_to(count, out.shape).astype(np.int64)
    for _ in range(scale_steps):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out


class Language:
    """What a task holds of one language: its sources with their totals, and the distances added up so far."""

    def __init__(self, sources: list[str], totals: list[int], n_terms: int, smoothing: int):
        self.sources, self.totals = sources, np.array(totals, np.int64) + smoothing * n_terms
        self.whole, self.smoothing = int(sum(totals)) + smoothing * n_terms, smoothing
        self.distance = np.zeros((len(sources), len(sources)), np.int64)

    def add(self, sources: list[str], terms: list[bytes], counts: np.ndarray, most: int) -> Iterator[tuple[str, str, int]]:
        """One chunk's counts: distances are added, the best terms of each source come out."""
        kept = np.array(sorted(set(terms)), object)
        group = np.array([bisect.bisect_left(self.sources, s) for s in sources], np.int64)
        at = group * len(kept) + np.searchsorted(kept, np.array(terms, object))
        dense = np.bincount(at, counts, len(self.sources) * len(kept)).astype(np.int64).reshape(len(self.sources), len(kept))
        shares = 1 + share(dense + self.smoothing, self.totals[:, None])
        all_of = 1 + share(dense.sum(0) + self.smoothing, self.whole)
        for g, name in enumerate(self.sources):
            self.distance[g] += np.abs(shares[g] - shares).sum(1)
            above = shares[g] - all_of
            ids = np.flatnonzero((dense[g] > 0) & (above > 0))
            for k in ids[np.argsort(-above[ids], kind="stable")[:most]].tolist():
                yield name, kept[k].decode(), int(above[k])


def _measured(rows: DataFrame, smoothing: int, most: int) -> DataFrame:
    """(lang, source, part, item, value) from rows (lang, chunk, kind, source, term, n, n_terms), all of a chunk in one task and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "source", "part", "item", "value"]
        language: Language | None = None
        lang = chunk = None
        groups: list[tuple[str, int, int]] = []
        cells: list[tuple[str, bytes, int]] = []

        def made(part: str, found: list[tuple[str, str, int]]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(columns[0], pa.string()), pa.array([part] * len(found), pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=names)

        def close_chunk() -> Iterator[pa.RecordBatch]:
            nonlocal language
            if groups and language is None:
                language = Language([g[0] for g in groups], [g[1] for g in groups], groups[0][2], smoothing)
            if cells:
                sources, terms, counts = zip(*cells, strict=True)
                yield made("term", list(language.add(list(sources), list(terms), np.array(counts, float), most)))
            groups.clear()
            cells.clear()

        def close_language() -> Iterator[pa.RecordBatch]:
            nonlocal language
            if language is not None:
                for g, name in enumerate(language.sources):
                    yield made("pair", [(name, other, int(v)) for h, (other, v) in enumerate(zip(language.sources, language.distance[g].tolist(), strict=True)) if h != g])
            language = None

        for batch in batches:
            for own, part, kind, source, term, n, n_terms in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (own, part) != (lang, chunk):
                    yield from close_chunk()
                    if own != lang:
                        yield from close_language()
                    lang, chunk = own, part
                if kind == 0:
                    groups.append((source, n, n_terms))
                else:
                    cells.append((source, term.encode(), n))
        yield from close_chunk()
        yield from close_language()

    return rows.mapInArrow(lean(run), "lang string, source string, part string, item string, value long")


def source_divergence(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 30, smoothing: int = 5, most_terms: int = 50
) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows for every other source of the language, ``term`` rows for its most over-used terms."""
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counts = cut(counted(docs), "counts")
    kept = cut(counts.groupBy("lang", "term").agg(F.sum("df").alias("df")).filter(F.col("df") >= least_docs).select("lang", "term"), "kept")
    # written first, so that the hot partitions of the joins that follow can be split
    used = cut(counts.join(kept, ["lang", "term"], "left_semi").select("lang", "source", "term", "n"), "used")
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("n_terms"))
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    groups = cut(groups.select("lang", "source", F.coalesce("total", F.expr("0L")).alias("total"), F.coalesce("n_terms", F.expr("0L")).alias("n_terms")), "groups")
    width = groups.groupBy("lang").agg(F.greatest(F.lit(1), F.least(F.lit(CHUNK), F.lit(CELLS) / F.count("*"))).cast("long").alias("width"))
    chunks = cut(chunked(kept.join(width, "lang")), "chunks")
    firsts = chunks.select("lang", "chunk").distinct()
    cells = _routed(used, chunks, firsts).select("lang", "chunk", F.lit(1).alias("kind"), "source", "term", "n", F.lit(None).cast("long").alias("n_terms"))
    heads = groups.join(firsts, "lang").select("lang", "chunk", F.lit(0).alias("kind"), "source", F.lit(None).cast("string").alias("term"), F.col("total").alias("n"), "n_terms")
    measured = cut(_measured(cells.unionByName(heads).repartition("lang", "chunk").sortWithinPartitions("lang", "chunk", "kind", "source"), smoothing, most_terms), "measured")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    terms = measured.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most_terms)
    summed = cut(measured.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("found")), "distances")
    every = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source != item")
    pairs = every.join(summed, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("found", F.expr("0L")).alias("value"))
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)


def _routed(used: DataFrame, chunks: DataFrame, firsts: DataFrame) -> DataFrame:
    """The counts with their chunk: looked up among the chunks' first terms, or joined if those are too many to send."""
    weight = firsts.agg(F.coalesce(F.sum(F.octet_length("lang") + F.octet_length("chunk") + 16), F.lit(0)).alias("bytes")).first()["bytes"]
    if weight > MOST_SENT:
        return used.join(chunks, ["lang", "term"])
    found: dict[str, list[bytes]] = {}
    for lang, first in firsts.collect():
        found.setdefault(lang, []).append(first.encode())
    sent = used.sparkSession.sparkContext.broadcast({k: sorted(v) for k, v in found.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk = np.empty(batch.num_rows, object)
            langs = batch.column("lang").to_pylist()
            terms = np.array([t.encode() for t in batch.column("term").to_pylist()], object)
            for lang in set(langs):
                at = np.flatnonzero(np.array([x == lang for x in langs]))
                own = np.array(sent.value[lang], object)
                chunk[at] = own[np.searchsorted(own, terms[at], "right") - 1]
            yield batch.append_column("chunk", pa.array([c.decode() for c in chunk], pa.string()))

    return used.mapInArrow(lean(run), "lang string, source string, term string, n long, chunk string")


# --- the same in SQL, for tests and the catalogue's check

ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT k, lang, source, term, count(*) AS n FROM (SELECT k, lang, source, unnest(ws) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(*) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
c AS (SELECT g.lang, g.source, kept.term, coalesce(x.n, 0) AS n FROM g JOIN kept USING (lang)
      LEFT JOIN (SELECT lang, source, term, sum(n) AS n FROM t GROUP BY ALL) x ON x.lang = g.lang AND x.source = g.source AND x.term = kept.term),
p AS (SELECT lang, source, term, n, CAST(1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS BIGINT) AS p FROM c JOIN v USING (lang)),
q AS (SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS BIGINT) AS q
      FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
          ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms) WHERE rank <= 50
"""
