"""Approximate nearest neighbours by inverted lists and residual product codes.

1. Centroids and codes are fitted on a sample of stated size; lists are more, the more rows there are. A row goes to its nearest
   centroid's list, and what is left of it is coded in groups of ``SUB_DIMS`` numbers, a byte each.
2. Codes are stored in folders of shards, which hold several lists each and are as many as the bytes ask for; a large shard is dealt
   over files by id, so one frequent list is not one task's work. Vectors are stored beside them, for the exact scores.
3. How many lists a query has to look into is measured: for a sample of rows, where in the order of its centroids the lists of its
   true neighbours stand. That is few where vectors cluster, and nearly all where they do not.
4. Queries travel to the shards of their lists, in blocks. A task scores the codes of those lists and keeps ``pool`` rows a query; of
   these the best of all shards are scored exactly. So exactly scored pairs are ``pool`` a query, whatever the number of rows.

Similarity is cosine. Vectors of another width or of length zero are in no list. No rows: no lists, and nothing is found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketspark.operators.retrieval import cosine, knn, matrix
from docketspark.session import cut, fingerprint, kept

SUB_DIMS = 2
CODES = 256
SHARD_BYTES = 32 << 20
BLOCK = 256
MOST_VISITS = 1 << 14


def k_means(points: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """At most ``k`` centres; empty ones stay where they were."""
    centres = points[np.random.default_rng(seed).choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        own = (points @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def units(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of length one; not a number where there is no direction."""
    rows = matrix(column, dims)
    with np.errstate(invalid="ignore", divide="ignore"):
        return rows / np.linalg.norm(rows, axis=1, keepdims=True)


class Codebook:
    """Centroids of lists, and of each group of dimensions of what is left of a vector."""

    def __init__(self, sample: np.ndarray, lists: int, sub_dims: int = SUB_DIMS):
        self.lists, self.sub_dims = k_means(sample, lists), sub_dims
        rest = sample - self.lists[(sample @ self.lists.T).argmax(1)]
        self.parts = [k_means(rest[:, i : i + sub_dims], CODES) for i in range(0, sample.shape[1], sub_dims)]

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = (rows @ self.lists.T).argmax(1)
        rest = rows - self.lists[own]
        codes = np.empty((len(rows), len(self.parts)), np.uint8)
        for k, centres in enumerate(self.parts):
            part = rest[:, k * self.sub_dims : (k + 1) * self.sub_dims]
            codes[:, k] = (part @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        return own, codes

    def decode(self, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return (self.lists[own] + np.concatenate([centres[codes[:, k]] for k, centres in enumerate(self.parts)], 1)).astype(np.float32)

    def order(self, queries: np.ndarray) -> np.ndarray:
        """[query, place]: the lists, the nearest first."""
        return np.argsort(-(queries @ self.lists.T), 1, kind="stable")


class VectorIndex:
    def __init__(
        self, rows: DataFrame, dims: int, key: tuple, id_col: str = "id", vector: str = "embedding", most_sample: int = 8192, measured: int = 64, k: int = 10, least_recall: float = 0.98, source: DataFrame | None = None, path: str | None = None
    ):
        """``most_sample`` rows fit the codebook and ``measured`` of them the number of lists to look into, for ``k`` neighbours."""
        spark, self.dims = rows.sparkSession, dims
        key = (*key, dims, fingerprint(source if source is not None else rows))
        given = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")).filter(F.col("id").isNotNull() & (F.size("v") == dims))
        n = given.count()
        self.shards = max(1, math.ceil(n * (dims // SUB_DIMS + 16) / SHARD_BYTES))
        taken = given.orderBy(F.xxhash64("id"), "id").limit(most_sample).toArrow()
        points = units(taken["v"].combine_chunks(), dims) if n else np.zeros((0, dims))
        points = points[np.isfinite(points).all(1)]
        self.book = None
        if not len(points):
            return
        self.book = Codebook(points, max(1, min(round(2 * math.sqrt(n)), len(points) // 8)))
        self.sent = spark.sparkContext.broadcast(self.book)  # of the sample's size at most

        def coded() -> DataFrame:
            parts = max(1, math.ceil(self.shards / 8))
            return self._encoded(given).repartition(self.shards * parts, "shard", F.pmod(F.xxhash64("id"), F.lit(parts)))

        self.codes = kept(spark, (*key, "codes"), coded, "shard", path)
        self.vectors = kept(spark, (*key, "vectors"), lambda: given, path=path)
        self.probes = self._measured(given, measured, k, least_recall)

    def _encoded(self, given: DataFrame) -> DataFrame:
        sent, dims, shards = self.sent, self.dims, self.shards

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = units(batch.column("v"), dims)
                good = np.isfinite(x).all(1)
                own, codes = sent.value.encode(x[good])
                yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(good)), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array((own % shards).astype(np.int32))], names=["id", "list", "code", "shard"])

        return given.mapInArrow(run, "id long, list int, code binary, shard int")

    def _measured(self, given: DataFrame, measured: int, k: int, least_recall: float) -> int:
        """The least number of lists in which that share of the true neighbours of sampled rows is."""
        asked = cut(given.orderBy(F.xxhash64(F.lit("measured"), "id"), "id").limit(measured), "measured")
        near = knn(given, asked, k + 1, self.dims, vector="v").filter("query_id != id").join(self.codes.select("id", "list"), "id").select("query_id", "list").collect()  # k rows a sampled one
        names = asked.toArrow()
        order = self.book.order(units(names["v"].combine_chunks(), self.dims))
        place = {q: np.argsort(own) for q, own in zip(names["id"].to_pylist(), order, strict=True)}
        needed = sorted(int(place[r["query_id"]][r["list"]]) + 1 for r in near)
        return needed[min(len(needed) - 1, math.ceil(least_recall * len(needed)) - 1)] if needed else len(self.book.lists)

    def search(self, queries: DataFrame, k: int, id_col: str = "id", vector: str = "embedding", pool: int | None = None, probes: int | None = None) -> DataFrame:
        """(query_id, id, score, rank): as ``knn`` by cosine, over the lists measured; exact scores of ``pool`` rows a query (four times ``k``)."""
        spark = queries.sparkSession
        if self.book is None:
            return spark.createDataFrame([], "query_id long, id long, score double, rank int")
        pool, probes = pool or 4 * k, min(probes or self.probes, len(self.book.lists))
        asked = cut(queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector).alias("v")), "asked")
        visits = self._routed(asked, probes)
        # shards with many visits are read by several tasks, each with some of the visits
        salts = cut(visits.groupBy("shard").agg(F.ceil(F.count("*") / MOST_VISITS).alias("salts")), "salts")
        none = F.lit(None)
        guests = visits.join(salts, "shard").select("shard", F.pmod(F.xxhash64("query_id"), F.col("salts")).alias("salt"), F.lit(1).alias("kind"), F.col("query_id").alias("id"), none.cast("int").alias("list"), none.cast("binary").alias("code"), "v", "lists")
        parts = max(1, math.ceil(self.shards / 8))
        there = self.codes.join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
        kind = asked.schema["v"].dataType
        members = there.select("shard", "salt", F.lit(0).alias("kind"), "id", "list", "code", none.cast(kind).alias("v"), none.cast("array<int>").alias("lists"))
        part = F.pmod(F.xxhash64("id"), F.lit(parts))
        dealt = members.withColumn("part", part).unionByName(guests.withColumn("part", F.explode(F.array(*[F.lit(i).cast("long") for i in range(parts)]))))
        together = dealt.repartition(max(self.shards * parts, 1), "shard", "salt", "part").sortWithinPartitions("shard", "salt", "part", "kind")
        likely = together.mapInArrow(_scan(self.sent, self.dims, pool), "query_id long, id long, near float")
        order = W.partitionBy("query_id").orderBy(F.desc("near"), F.asc("id"))
        few = cut(likely.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= pool).select("query_id", "id"), "likely")
        exact = few.join(self.vectors, "id").join(asked.select("query_id", F.col("v").alias("q")), "query_id").select("query_id", "id", cosine(F.col("q"), F.col("v")).alias("score"))
        order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
        return exact.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def _routed(self, asked: DataFrame, probes: int) -> DataFrame:
        """(query_id, v, shard, lists): each query once for every shard that has some of its lists."""
        sent, dims, shards = self.sent, self.dims, self.shards

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, where, lists = [], [], []
                for i, own in enumerate(sent.value.order(np.nan_to_num(units(batch.column("v"), dims)))[:, :probes]):
                    for shard in np.unique(own % shards).tolist():
                        rows.append(i)
                        where.append(shard)
                        lists.append(own[own % shards == shard].tolist())
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(take), batch.column("v").take(take), pa.array(where, pa.int32()), pa.array(lists, pa.list_(pa.int32()))], names=["query_id", "v", "shard", "lists"])

        return asked.mapInArrow(run, f"query_id long, v {asked.schema['v'].dataType.simpleString()}, shard int, lists array<int>")


def _scan(sent, dims: int, pool: int):
    """Per shard: codes first, which are held; then the queries, a block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        ids, lists, rows = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros((0, dims), np.float32)
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("shard", "salt", "part", "kind")), strict=True))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if keys[a][:3] != key:
                    key, held = keys[a][:3], []
                    ids, lists, rows = ids[:0], lists[:0], rows[:0]
                if keys[a][3] == 0:
                    own = part.column("list").to_numpy()
                    codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(own), -1)
                    held.append((part.column("id").to_numpy(), own, codes))
                    continue
                if held:
                    ids, lists, codes = (np.concatenate(x) for x in zip(*held, strict=True))
                    rows, held = sent.value.decode(lists, codes), []
                for i in range(0, part.num_rows, BLOCK):
                    yield _top(part.slice(i, BLOCK), dims, pool, ids, lists, rows, len(sent.value.lists))

    return run


def _top(asked: pa.RecordBatch, dims: int, pool: int, ids: np.ndarray, lists: np.ndarray, rows: np.ndarray, n_lists: int) -> pa.RecordBatch:
    q = np.nan_to_num(units(asked.column("v"), dims)).astype(np.float32)
    wanted = np.zeros((len(q), n_lists), bool)
    own = asked.column("lists")
    wanted[np.repeat(np.arange(len(q)), pa.compute.list_value_length(own).to_numpy()), own.flatten().to_numpy()] = True
    near = np.zeros((len(q), 0), np.float32)
    best = np.zeros((len(q), 0), np.int64)
    for i in range(0, len(ids), 4096):
        some = np.where(wanted[:, lists[i : i + 4096]], q @ rows[i : i + 4096].T, np.float32(-9))
        near, best = np.concatenate([near, some], 1), np.concatenate([best, np.broadcast_to(ids[i : i + 4096], some.shape)], 1)
        if near.shape[1] > pool:
            at = np.argpartition(-near, pool - 1, 1)[:, :pool]
            near, best = np.take_along_axis(near, at, 1), np.take_along_axis(best, at, 1)
    keep = (near > -9).ravel()
    names = np.repeat(asked.column("id").to_numpy(), near.shape[1])
    return pa.RecordBatch.from_arrays([pa.array(names[keep]), pa.array(best.ravel()[keep]), pa.array(near.ravel()[keep], pa.float32())], names=["query_id", "id", "near"])
