"""A stored index of postings with positions, and what is answered from it without a text being read: BM25, phrases and
web-style queries, and rank by cover density.

Postings are stored in blocks (bucket, term, number of texts, packed ids, counts, sizes and positions), in folders by bucket of the
term, sorted by term. A block is a term in some MB of texts, so a frequent term has few rows, each of bounded size. Buckets and files
are as many as the texts' bytes ask for. Terms that a question has are looked up by bucket where they are few, so only their
folders are read; more are joined. A frequent term's blocks are dealt over its bucket's files.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketspark.functions.stem import STOP, english_stem
from docketspark.functions.varint import deltas, pack, runs, sums, unpack, unzigzag, zigzag
from docketspark.functions.words import encoded, numbered
from docketspark.operators.fulltext import parse
from docketspark.session import cut, fingerprint, kept, lean, small_batches, usual_batches

FILE_BYTES = 2 << 20  # of text whose postings go to one bucket
PART_BYTES = 128 << 20  # of text whose postings go to one file of a bucket, once there are the most buckets
BLOCK_BYTES = 8 << 20  # of text whose postings of a term are one block
READ_BYTES = 1 << 20  # of text whose words are found at once
MOST_BUCKETS = 4096
MOST_LOOKED_UP = 2000
MOST_SENT = 1 << 18  # terms, or ids of questions, that are sent to all tasks, so that the index is not shuffled
PAIRS = 1 << 20  # of a question and a text, by one term, that are a task's
OPENED = 1 << 18  # postings, or positions, that are opened, or packed, at once


def english(word: str) -> str | None:
    """Stems of English words; none of stop words."""
    return None if word in STOP else english_stem(word)


BLOCKS = "term string, n int, total long, ids binary, tfs binary, sizes binary, places binary"


def blocks_of(docs: DataFrame, id_col: str, text_col: str, term_of: Callable[[str], str | None] | None = None) -> DataFrame:
    """Blocks of postings: a term's texts in some MB of texts. A text is whole in its row, so its terms meet there, and what is shuffled
    is packed: ids and positions as differences, with the counts and the texts' sizes, in as many bytes as each number needs.

    Of a block's texts four bytes a word are held, whatever batches they come in; their words are found in slices and packed in portions.
    """
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.lower(F.col(text_col)).alias("text"))
    return rows.mapInArrow(lean(lambda batches: _blocks(batches, term_of)), BLOCKS)


def _blocks(batches: Iterator[pa.RecordBatch], term_of: Callable[[str], str | None] | None) -> Iterator[pa.RecordBatch]:
    parts, words, ids, held = [], [], [], 0
    for batch in batches:
        own, texts = batch.column("id").to_numpy(), batch.column("text").cast(pa.string()).fill_null("")
        for first, found, sizes in encoded(texts, READ_BYTES):
            length = pc.sum(pc.binary_length(texts.slice(first, len(sizes)))).as_py() + 8 * len(sizes)  # with the ids, so that rows are bounded too
            if held and held + length > BLOCK_BYTES:
                yield from _packed(parts, words, ids, term_of)
                parts, words, ids, held = [], [], [], 0
            parts += found
            words.append(sizes)
            ids.append(own[first : first + len(sizes)])
            held += length
    if ids:
        yield from _packed(parts, words, ids, term_of)


def _packed(parts: list[pa.DictionaryArray], words: list[np.ndarray], ids: list[np.ndarray], term_of: Callable[[str], str | None] | None) -> Iterator[pa.RecordBatch]:
    """The blocks of some rows, some terms at a time: ``parts`` are the rows' words in order, ``words`` how many each row has."""
    code, terms = numbered(parts, term_of)
    sizes, ids = np.concatenate(words), np.concatenate(ids)
    begins = np.cumsum(sizes) - sizes
    order = np.argsort(code, kind="stable")
    total = np.bincount(code + 1, minlength=len(terms) + 1)
    at, total = int(total[0]), total[1:]
    for start, stop in _portions(total):
        word = order[at : at + int(total[start:stop].sum())]
        at += len(word)
        row = np.searchsorted(begins, word, "right") - 1
        term = np.repeat(np.arange(start, stop), total[start:stop])
        by = np.lexsort((ids[row], term))
        row, place = row[by], (word - begins[row])[by]
        first = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
        tf, row, n = np.diff(np.append(first, len(term))), row[first], np.bincount(term[first] - start)
        steps = deltas(ids[row], n)
        heads = np.cumsum(n) - n
        steps[heads] = zigzag(steps[heads]).view(np.int64)
        packed = [pack(steps, n), pack(tf, n), pack(sizes[row], n), pack(deltas(place, tf), total[start:stop])]
        yield pa.RecordBatch.from_arrays([terms[start:stop], pa.array(n, pa.int32()), pa.array(total[start:stop], pa.int64()), *packed], names=[x.split()[0] for x in BLOCKS.split(", ")])


def _portions(counts: np.ndarray, most: int = OPENED) -> Iterator[tuple[int, int]]:
    """Row ranges whose counts add up to at most ``most``; a row of more has a range of its own."""
    ends = np.cumsum(counts)
    start = 0
    while start < len(counts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield start, stop
        start = stop


def opened(blocks: DataFrame, positions: bool = False) -> DataFrame:
    """(term, id, tf, size), and maybe positions, a row a posting. As many blocks are opened at once as have some postings, or positions,
    so what a worker holds does not grow with the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in _portions(batch.column("total" if positions else "n").to_numpy().astype(np.int64)):
                yield _opened(batch.slice(start, stop - start), positions)

    columns = ["term", "n", "ids", "tfs", "sizes", *(["total", "places"] if positions else [])]
    return blocks.select(*columns).mapInArrow(lean(run), "term string, id long, tf int, size int" + ", positions array<int>" * positions)


def terms_of(blocks: DataFrame, ids: list[int]) -> DataFrame:
    """(id, term) of the texts of ``ids`` alone: the other postings are passed over where the blocks are opened."""
    sent = blocks.sparkSession.sparkContext.broadcast(np.array(sorted(ids), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in _portions(batch.column("n").to_numpy().astype(np.int64)):
                some = batch.slice(start, stop - start)
                found, block = _ids(some)
                own = np.isin(found, sent.value)
                yield pa.RecordBatch.from_arrays([pa.array(found[own]), some.column("term").take(pa.array(block[own]))], names=["id", "term"])

    return blocks.select("term", "n", "ids").mapInArrow(lean(run), "id long, term string")


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all postings, and of each the number of its block."""
    n = batch.column("n").to_numpy().astype(np.int64)
    begins, block = runs(n)
    steps = unpack(batch.column("ids"))
    steps[begins] = unzigzag(steps[begins])
    return sums(steps, n), block


def _opened(batch: pa.RecordBatch, positions: bool) -> pa.RecordBatch:
    ids, block = _ids(batch)
    tf = unpack(batch.column("tfs"))
    columns = [batch.column("term").take(pa.array(block)), pa.array(ids), pa.array(tf, pa.int32()), pa.array(unpack(batch.column("sizes")), pa.int32())]
    if positions:
        ends = np.zeros(len(tf) + 1, np.int32)
        np.cumsum(tf, out=ends[1:])
        columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(sums(unpack(batch.column("places")), tf), pa.int32())))
    return pa.RecordBatch.from_arrays(columns, names=["term", "id", "tf", "size", "positions"][: len(columns)])


def best(scored: DataFrame, k: int, score: str = "score", tie: str = "id", by: str = "query_id") -> DataFrame:
    """The best ``k`` of every question with their rank; ties by id."""
    order = W.partitionBy(by).orderBy(F.desc(score), F.asc(tie))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class TermIndex:
    """The postings of a corpus, its texts' sizes and its statistics, written once for each state of the data."""

    def __init__(self, docs: DataFrame, key: tuple, id_col: str = "id", text_col: str = "text", term_of: Callable[[str], str | None] | None = None, source: DataFrame | None = None, path: str | None = None, file_bytes: int = FILE_BYTES):
        """``term_of``: a word's term, or None to leave the word out; questions' words go through it too. ``source``: the files' table, whose
        names, sizes and times tell one state of the data from another. ``path``: where the index stays after the application."""
        spark, self.term_of, self._known = docs.sparkSession, term_of, None
        usual_batches(spark)
        small_batches(spark, few_rows=False)  # of long texts, and of blocks of frequent terms
        key = (*key, getattr(term_of, "__qualname__", ""), fingerprint(source if source is not None else docs))
        volume = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("bytes"))

        def shape() -> DataFrame:
            return volume.select(F.greatest(F.lit(1), F.least(F.lit(MOST_BUCKETS), F.ceil(F.col("bytes") / file_bytes))).cast("int").alias("buckets"), "bytes")

        stored = kept(spark, (*key, "shape"), shape, path=path).first()
        self.buckets = stored["buckets"]
        parts = max(1, math.ceil(stored["bytes"] / (self.buckets * max(file_bytes, PART_BYTES))))

        def postings() -> DataFrame:
            found = blocks_of(docs, id_col, text_col, term_of).withColumn("bucket", self._bucket(F.col("term")))
            return found.repartition(self.buckets * parts, "bucket", F.pmod(F.xxhash64("ids"), F.lit(parts))).sortWithinPartitions("bucket", "term")

        def sizes() -> DataFrame:
            words = F.regexp_count(F.lower(F.col(text_col)), F.lit("[a-z0-9]++"))
            return docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), words.cast("int").alias("size"))

        self.blocks = kept(spark, (*key, "blocks"), postings, "bucket", path)
        self.sizes = kept(spark, (*key, "sizes"), sizes, path=path)  # null where there is no text
        self.statistics = kept(spark, (*key, "statistics"), lambda: self.sizes.agg(F.count("*").alias("n"), F.avg("size").alias("mean")), path=path)

    def _bucket(self, term):
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def terms(self, asked: DataFrame) -> DataFrame:
        """``asked`` with its ``term`` as the index has it; words that it leaves out go."""
        if self.term_of is None:
            return asked
        term_of = self.term_of

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.schema.get_field_index("term")
                made = pa.array([term_of(t) for t in batch.column("term").to_pylist()], pa.string())
                yield batch.set_column(at, "term", made).filter(made.is_valid())

        return asked.mapInArrow(run, asked.schema)

    def _asked(self, asked: DataFrame, own_terms: bool) -> DataFrame:
        asked = asked.select("query_id", "term")
        return (asked if own_terms else self.terms(asked)).distinct()

    def _measures(self) -> tuple[int, float]:
        """The number of rows and the mean size of texts; read once."""
        if self._known is None:
            row = self.statistics.first()
            self._known = (row["n"], row["mean"] or 0.0)
        return self._known

    @property
    def postings(self) -> DataFrame:
        """(term, id, tf, size) of all texts."""
        return opened(self.blocks)

    def of_terms(self, terms: DataFrame, positions: bool = False) -> DataFrame:
        """The postings of the distinct ``terms`` (term)."""
        return opened(self._blocks_of(terms), positions)

    def _blocks_of(self, terms: DataFrame) -> DataFrame:
        """Up to ``MOST_LOOKED_UP`` terms are looked up in their buckets, up to ``MOST_SENT`` sent to the blocks; more are joined."""
        asked = terms.select("term").distinct()
        few = asked.limit(MOST_LOOKED_UP + 1).withColumn("bucket", self._bucket(F.col("term"))).collect()
        if len(few) > MOST_LOOKED_UP:
            asked = asked.withColumn("bucket", self._bucket(F.col("term")))
            sent = asked.limit(MOST_SENT + 1).count() <= MOST_SENT
            return self.blocks.join(F.broadcast(asked) if sent else asked, ["bucket", "term"])
        return self.blocks.filter(F.col("bucket").isin(sorted({r["bucket"] for r in few})) & F.col("term").isin(sorted(r["term"] for r in few)))

    def frequencies(self, terms: DataFrame) -> DataFrame:
        """(term, df) of the distinct ``terms`` (term)."""
        return self._blocks_of(terms).groupBy("term").agg(F.sum("n").alias("df"))

    def rarest(self, questions: DataFrame, most: int, least_df: int = 2) -> DataFrame:
        """(query_id, term): of each stated row (query_id, an indexed id) its rarest terms that another row has."""
        ids = questions.select(F.col("query_id").cast("long").alias("id")).distinct()
        few = [r["id"] for r in ids.filter("id IS NOT NULL").limit(MOST_SENT + 1).collect()]
        found = terms_of(self.blocks, few) if len(few) <= MOST_SENT else self.postings.join(ids, "id", "left_semi")
        own = cut(found.select(F.col("id").alias("query_id"), "term"), "own-terms")
        counted = own.join(self.frequencies(own), "term").filter(F.col("df") >= least_df)
        order = W.partitionBy("query_id").orderBy("df", "term")
        return counted.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("query_id", "term")

    def search(self, asked: DataFrame, k: int, allowed: DataFrame | None = None, k1: float = 1.2, b: float = 0.75, own_terms: bool = False) -> DataFrame:
        """(query_id, id, score, rank): the best ``k`` by BM25 for every question of ``asked`` (query_id, term).

        Statistics are of the whole corpus; ``allowed`` (id) says which rows may be found; where it and ``asked`` have a ``scope``, each
        question finds those of its own scope. ``own_terms``: the terms are the index's already.
        """
        scopes = asked.select("query_id", "scope").distinct() if "scope" in asked.columns else None
        asked = self._asked(asked, own_terms)
        blocks = self._blocks_of(asked)
        weighed, keys = cut(asked.join(blocks.groupBy("term").agg(F.sum("n").alias("df")), "term"), "weighed"), ["term"]
        rows, pairs = weighed.agg(F.count("*"), F.coalesce(F.sum("df"), F.lit(0))).first()
        # dealt by text, a question's rows of a text meet where they are made, and each task keeps its own best: pairs are not moved
        found = opened(blocks).repartition(max(math.ceil(pairs / PAIRS), blocks.sparkSession.sparkContext.defaultParallelism), "id")
        n, mean = map(F.lit, self._measures())
        idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / mean))
        if scopes is not None:
            found, weighed, keys = found.join(allowed.select("id", "scope"), "id"), weighed.join(scopes, "query_id"), ["term", "scope"]
        elif allowed is not None:
            found = found.join(allowed.select("id"), "id", "left_semi")
        scored = found.join(F.broadcast(weighed) if rows <= MOST_SENT else weighed, keys).groupBy("query_id", "id").agg(F.round(F.sum(part), 9).alias("score"))
        return best(scored, k)

    # --- web-style queries

    def clauses(self, queries: list[tuple[int, str]]) -> DataFrame:
        """(query_id, branch, clause, negated, place, n, term): the queries' words, each with its place in its phrase."""
        rows = []
        for query_id, text in queries:
            for branch, group in enumerate(parse(text)):
                for number, clause in enumerate(group):
                    made = [(place, word if self.term_of is None else self.term_of(word)) for place, word in enumerate(clause.words)]
                    made = [(place, term) for place, term in made if term is not None]
                    rows += [Row(query_id=query_id, branch=branch, clause=number, negated=clause.negated, place=place, n=len(made), term=term) for place, term in made]
        return self.postings.sparkSession.createDataFrame(rows, "query_id long, branch int, clause int, negated boolean, place int, n int, term string")

    def match(self, queries: list[tuple[int, str]], allowed: DataFrame | None = None) -> DataFrame:
        """(query_id, id): the rows that satisfy each stated web-style query (words, "phrases", OR, -negation).

        A clause of one word is its postings. A phrase is the texts in which some position is free for all of its words at once: their
        positions, each less its place in the phrase, intersect. A branch is the texts that have all its positive clauses and, by
        an anti-join, none of its negated ones; a query is the union of its branches. A branch of negations alone starts from all rows.
        """
        asked = cut(self.clauses(queries), "clauses")
        keys = ["query_id", "branch", "clause", "negated", "id"]
        hits = self.of_terms(asked, positions=True).select("term", "id", "positions").join(F.broadcast(asked), "term")  # the stated queries' words
        if allowed is not None:
            hits = hits.join(allowed.select("id"), "id", "left_semi")
        begins = F.transform("positions", lambda p: p - F.col("place"))
        phrases = hits.filter("n > 1").select(*keys, "n", "place", begins.alias("begins")).groupBy(*keys, "n").agg(F.collect_list("begins").alias("begins"))  # a list a word of the phrase
        together = F.aggregate(F.slice("begins", 2, F.greatest(F.size("begins") - 1, F.lit(0))), F.element_at("begins", 1), lambda both, x: F.array_intersect(both, x))
        adjacent = phrases.filter(F.size("begins") == F.col("n")).filter(F.size(together) > 0).select(*keys)
        found = cut(hits.filter("n = 1").select(*keys).unionByName(adjacent), "clause-hits")
        wanted = asked.filter("not negated").groupBy("query_id", "branch").agg(F.countDistinct("clause").alias("wanted"))
        reached = found.filter("not negated").groupBy("query_id", "branch", "id").agg(F.countDistinct("clause").alias("reached")).join(F.broadcast(wanted), ["query_id", "branch"]).filter("reached = wanted")
        every = self.sizes.select("id") if allowed is None else allowed.select("id").distinct()
        only_negated = [(r[0], r[1]) for r in asked.groupBy("query_id", "branch").agg(F.bool_and("negated").alias("all")).filter("all").select("query_id", "branch").collect()]
        candidates = reached.select("query_id", "branch", "id")
        if only_negated:  # stated branches against all rows
            pairs = F.array(*[F.struct(F.lit(q).cast("long").alias("query_id"), F.lit(b).alias("branch")) for q, b in only_negated])
            candidates = candidates.unionByName(every.select(F.inline(pairs), "id"))
        return candidates.join(found.filter("negated").select("query_id", "branch", "id").distinct(), ["query_id", "branch", "id"], "left_anti").select("query_id", "id").distinct()

    # --- cover density

    def cover_density(self, asked: DataFrame, k: int, allowed: DataFrame | None = None, own_terms: bool = False) -> DataFrame:
        """(query_id, id, score, rank): the best ``k`` texts that hold all of a question's terms, for every question of ``asked`` (query_id, term).

        Each minimal cover of the terms adds 1 / (its noise + 1): a span from one occurrence to another that holds every term and no
        shorter one inside; its noise is the number of words between that are no terms.
        """
        asked = cut(self._asked(asked, own_terms), "asked")
        sizes = asked.groupBy("query_id").agg(F.count("*").alias("n"))
        hits = self.of_terms(asked, positions=True).select("term", "id", "positions")
        if allowed is not None:
            hits = hits.join(allowed.select("id"), "id", "left_semi")
        lists = hits.join(asked, "term").groupBy("query_id", "id").agg(F.collect_list("positions").alias("lists"))  # a list a term of the question
        whole = lists.join(sizes, "query_id").filter(F.size("lists") == F.col("n")).select("query_id", "id", "lists")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                scores = [cover_score([np.array(own, np.int64) for own in lists.as_py()]) for lists in batch.column("lists")]
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("id"), pa.array(scores, pa.float64())], names=["query_id", "id", "score"])

        scored = whole.mapInArrow(run, f"query_id {asked.schema['query_id'].dataType.simpleString()}, id long, score double")
        return best(scored.select("query_id", "id", F.round("score", 9).alias("score")), k)


def cover_score(lists: list[np.ndarray]) -> float:
    """The sum over minimal covers of 1 / (noise + 1), from one sorted list of positions for each term."""
    place = np.concatenate(lists)
    order = np.argsort(place, kind="stable")
    place, term = place[order], np.repeat(np.arange(len(lists)), [len(own) for own in lists])[order]
    at = np.arange(len(place))
    first = at.copy()
    for k in range(len(lists)):  # where each term was seen last, at every hit; the furthest back begins the cover
        first = np.minimum(first, np.maximum.accumulate(np.where(term == k, at, -1)))
    new = (first >= 0) & (np.diff(first, prepend=-1) > 0)
    return float((1.0 / (1 + (place[new] - place[first[new]]) - (at[new] - first[new]))).sum())
