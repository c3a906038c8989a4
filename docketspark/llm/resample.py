"""Target-distribution importance resampling over hashed runs of words.

1. One scan per document: words go by one at a time, and a ring holds the running CRC-32 states of the last ``most_words``
   starts. Each word extends every state by a space and itself and opens a new one, so every run of 1 to ``most_words``
   words is hashed without being put together. The states modulo the number of buckets are what is emitted: one short
   integer a feature, written as a table, so texts are read once.
2. Bucket counts of documents and of the target are added up in tasks and then by Spark: ``buckets`` rows, whatever the data.
   From them comes each bucket's gain, the log ratio of the two smoothed distributions, in thousandths and rounded down.
3. A document's weight is the mean gain of its features. With Gumbel noise from a digest of its id, the highest scores are a
   sample without replacement in proportion to the exponential of the weights.
4. The draw is exact and needs no global sort: scores are integers of a range that logarithms bound, so their histogram
   is small; it gives the rank at which each score begins, and only documents of a score are ordered among themselves.

Defined cases: null text has no words; a document without features weighs 0; ids are hashed as their decimal text, null as
the empty text; of equal scores the smaller id is drawn first, null last, and rows equal in both take their ranks in any order;
documents of fewer than ``least_words`` words are never drawn; repeated rows count each; texts of any length are read whole,
in pieces of 1 MB; no target: every gain compares with the uniform distribution; empty tables give no rows; extra columns are
ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketspark.llm.common import filled, lean, pieces
from docketspark.session import cut

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BETWEEN = np.zeros(256, bool)
_BETWEEN[:48] = _BETWEEN[58:97] = _BETWEEN[123:128] = True
_BETWEEN[65:91] = False
_PIECE = 1 << 20


class Ring:
    """The CRC-32 states of the last starts, the newest last."""

    def __init__(self, most_words: int):
        self.most_words, self.states, self.n_words = most_words, [], 0

    def feed(self, words: list[bytes]) -> list[int]:
        """The hashes of all runs that end with one of the words, the longest run of a word first."""
        self.n_words += len(words)
        crc = zlib.crc32
        if self.most_words == 1:  # no state goes on
            return list(map(crc, words))
        states, older, out = self.states, self.most_words - 1, []
        for word in words:
            spaced = b" " + word
            states = [crc(spaced, s) for s in states[-older:]]
            states.append(crc(word))
            out += states
        self.states = states
        return out


def hashed(text: bytes, most_words: int) -> tuple[int, list[np.ndarray]]:
    """Number of words and, piece by piece, the hashes of the text's features."""
    ring, out = Ring(most_words), []
    if len(text) <= _PIECE:
        out.append(np.array(ring.feed(_WORD.findall(text.translate(_LOWER))), np.uint32))
    else:
        for a, b in pieces(np.frombuffer(text, np.uint8), _BETWEEN, _PIECE):
            out.append(np.array(ring.feed(_WORD.findall(text[a:b].translate(_LOWER))), np.uint32))
    return ring.n_words, out


def features(docs: DataFrame, buckets: int, most_words: int, id_col: str | None, text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, features): the buckets of all runs of words, two bytes each if they fit, else four."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32
    rows = docs.select((F.col(id_col) if id_col else F.lit(None).cast("long")).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, counts, found = [], [], []
            for text in filled(batch.column("text")).cast(pa.binary()):
                n_words, hashes = hashed(text.as_py(), most_words)
                own = b"".join((h % buckets).astype(kind).tobytes() for h in hashes)
                sizes.append(n_words)
                counts.append(len(own) // kind(0).itemsize)
                found.append(own)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(found, pa.binary())], names=["id", "n_words", "n_features", "features"])

    return rows.mapInArrow(lean(run), f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_features long, features binary")


def bucket_counts(found: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) of the buckets that occur; every task sends at most one row a bucket."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for own in batch.column(0):
                total += np.bincount(np.frombuffer(own.as_buffer(), kind), minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["bucket", "n"])

    return found.select("features").mapInArrow(lean(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Each bucket's gain; one row a bucket comes to the driver, and it is as many as the parameter says."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for out, counts in ((s, source), (t, target)):
        for bucket, n in counts.collect():
            out[bucket] = n
    all_s, all_t = float(s.sum()) + buckets, float(t.sum()) + buckets
    return np.array([math.floor(1000 * math.log((b + 1.0) * all_s / ((a + 1.0) * all_t))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight): the mean gain of the features, rounded down; 0 without features."""
    kind = np.uint16 if len(gain) <= 1 << 16 else np.uint32
    sent = found.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own in batch.column("features"):
                at = np.frombuffer(own.as_buffer(), kind)
                out.append(int(sent.value[at].sum()) // len(at) if len(at) else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.int64())], names=["id", "n_words", "n_features", "weight"])

    id_type = found.schema["id"].dataType.simpleString()
    return found.select("id", "n_words", "n_features", "features").mapInArrow(lean(run), f"id {id_type}, n_words long, n_features long, weight long")


def noise(id_col: Column, seed: int) -> Column:
    """Standard Gumbel noise in thousandths, rounded down, from a digest of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def drawn(scored: DataFrame, share: tuple[int, int], least_words: int) -> DataFrame:
    """``scored`` (written, with id, n_words and score) and ``rank``, null if not drawn: floor(share of the eligible) highest scores."""
    eligible = F.col("n_words") >= least_words
    hist = cut(scored.filter(eligible).groupBy("score").agg(F.count("*").alias("n")), "scores")
    coarse = F.floor(F.col("score") / 256)
    # scores are thousandths of sums of logarithms: some 10**5 values at most, in some hundreds of coarse ones
    above = W.orderBy(F.desc("coarse")).rowsBetween(W.unboundedPreceding, -1)
    higher = hist.groupBy(coarse.alias("coarse")).agg(F.sum("n").alias("n")).select("coarse", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("higher"))
    inside = W.partitionBy("coarse").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)
    begins = hist.withColumn("coarse", coarse).withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(higher, "coarse").select("score", (F.col("higher") + F.col("before")).alias("begins"))
    begins = cut(begins, "begins")
    total = hist.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    most = share[0] * total // share[1]
    # the scores that take part, by their range alone; ties at the last one are ordered below
    last = begins.filter(F.col("begins") < most).agg(F.min("score").alias("score")).first()["score"] if most else None
    if last is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    takes_part = eligible & (F.col("score") >= F.lit(last))
    order = W.partitionBy("score").orderBy(F.col("id").asc_nulls_last())
    placed = scored.filter(takes_part).withColumn("place", F.row_number().over(order)).join(F.broadcast(begins), "score")  # one row a score
    rank = (F.col("begins") + F.col("place")).cast("long")
    ranked = placed.select(*scored.columns, F.when(rank <= most, rank).alias("rank"))
    return ranked.unionByName(scored.filter(~takes_part).withColumn("rank", F.lit(None).cast("long")))


def resample(
    docs: DataFrame, target: DataFrame, share: tuple[int, int] = (10, 100), buckets: int = 10_000, most_words: int = 1, least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text"
) -> DataFrame:
    """One row per document: id, n_words, n_features, weight, score, rank (from 1 among the drawn, else null)."""
    found = cut(features(docs, buckets, most_words, id_col, text_col), "features")
    wanted = features(target, buckets, most_words, None, target_text_col)
    gain = gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets), buckets)
    scored = cut(weighed(found, gain).withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "scored")
    return drawn(scored, share, least_words)


# --- the same in SQL: CRC-32 byte by byte over the distinct words

ORACLE = r"""
WITH RECURSIVE tb AS (SELECT n, 0 AS k, n AS c FROM (SELECT unnest(range(256))::BIGINT AS n)
                      UNION ALL SELECT n, k + 1, CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM tb WHERE k < 8),
tbl AS (SELECT list(c ORDER BY n) AS l FROM tb WHERE k = 8),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
sw AS (SELECT doc_id, unnest(ws) AS w FROM dw), tw AS (SELECT unnest(ws) AS w FROM bw),
u AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM sw UNION SELECT w FROM tw)),
crc AS (SELECT w, h, 0 AS i, 4294967295::BIGINT AS c FROM u
        UNION ALL SELECT w, h, i + 1, xor(c >> 8, l[xor(c & 255, (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1) + 1]) FROM crc, tbl WHERE 2 * i < length(h)),
b AS (SELECT w, xor(c, 4294967295) % 10000 AS bucket FROM crc WHERE 2 * i = length(h)),
s AS (SELECT bucket, count(*) AS s FROM sw JOIN b USING (w) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM tw JOIN b USING (w) GROUP BY 1),
z AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS t_all),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket) CROSS JOIN z),
f AS (SELECT doc_id, sum(gain) AS total, count(*) AS n FROM sw JOIN b USING (w) JOIN g USING (bucket) GROUP BY 1),
x AS (SELECT dw.doc_id, len(ws) AS n_features, CAST(coalesce(floor(total / n::DOUBLE), 0) AS BIGINT) AS weight,
             CAST(coalesce(floor(total / n::DOUBLE), 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || dw.doc_id), 1, 8))::BIGINT + 0.5) / 4294967296))) AS BIGINT) AS score
      FROM dw LEFT JOIN f USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM x WHERE n_features >= 20)
SELECT x.doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM x LEFT JOIN r USING (doc_id)
"""
