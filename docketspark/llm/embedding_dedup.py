"""Embedding near-dedup on a robust-pruned flat graph, built on overlapping cluster shards.

1. Equal vectors of one label are one class with one row, told by 128 bits, so copies are never compared.
2. Classes are dealt to shards of at most ``MOST_ROWS`` by k-means, level by level, each cell of its own and on a sample of it
   taken in the task that splits it, so neither driver nor task sees more than ``SAMPLE`` rows of a cell, however large. At
   each level a class also goes to the second nearest cell, so shards overlap. A cell that k-means does not divide, of
   vectors almost alike, is dealt by a hash, and a few of its rows go to all of its parts.
3. A task builds the graph of one shard: near and random candidates pruned robustly, ways back, ways in for rows that pruning
   left without, and every row reached from the medoid. The shards' adjacency lists are united by class.
4. Every class is searched for in its own shards, greedily from their medoids, then from every row found in range on,
   until nothing new is in range. What is found is verified by cosine in doubles. A row in range that lies in further shards too
   leads the search there: only (class, shard) moves, never a pair. A shard counts the rows that are at home in it, so each
   link counts once, and it sends a spanning forest of its links, not the links.
5. Recall is audited by brute force on a sample of stated size against all rows; below ``LEAST_RECALL`` the beam is doubled
   and the search done again, up to ``MOST_BEAM``.

Defined cases: a null label or vector, one with a null or non-finite component, or of length zero links with nothing; vectors
of different widths do not link; equal vectors always link; rows that repeat an id count each; a null id is larger than
any other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketspark.llm.common import lean, mix
from docketspark.llm.graph import QUERIES, FlatGraph
from docketspark.llm.minhash import components
from docketspark.session import cut

MOST_ROWS = 1024
SAMPLE = 4096
MOST_PARTS = 32
SHARED = 16
BEAM, MOST_BEAM = 32, 256
AUDIT = 256
LEAST_RECALL = 0.95
MOST_VISITS = 4096


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one width as unit rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    flat = flat / np.abs(flat).max(1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(1, keepdims=True))


def classes_of(rows: DataFrame, id_col: str, vector: str, label: str) -> tuple[DataFrame, DataFrame]:
    """All rows as (id, space, h1, h2), with a null space if they link with nothing; the classes (cls, space, h1, h2, least, n, v)."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    space = F.when(F.col("label").isNotNull() & v.isNotNull() & finite, F.concat_ws(":", F.size("v").cast("string"), F.col("label").cast("string")))
    given = rows.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    marked = given.select("id", "v", space.alias("space"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    grouped = marked.filter("space is not null").groupBy("space", "h1", "h2").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = cut(grouped.withColumn("cls", F.monotonically_increasing_id()), "classes")
    return marked.select("id", "space", "h1", "h2"), classes


def by_shard(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each key, one key at a time, from batches in the order of the keys."""
    key, held = None, []
    for batch in batches:
        own = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        edges = [0, *(i for i in range(1, len(own)) if own[i] != own[i - 1]), len(own)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            if held and own[a] != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = own[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


def centres_of(x: np.ndarray, parts: int, rounds: int = 8) -> np.ndarray:
    """Centres by spherical k-means; none if they do not divide the rows."""
    centres = x[np.random.default_rng(3).choice(len(x), min(parts, len(x)), replace=False)]
    own = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-12), centres)
    return centres if np.bincount(own).max() <= 0.8 * len(x) else centres[:0]


def place(classes: DataFrame, most_rows: int = MOST_ROWS, sample: int = SAMPLE) -> DataFrame:
    """(cls, space, path, home, n, v): every class in its home shard and in the second nearest of each level."""
    placed, level = classes.select("cls", "space", F.lit("").alias("path"), F.lit(True).alias("home"), "n", "v"), 0
    while True:
        sizes = placed.groupBy("space", "path").agg(F.count("*").alias("size")).filter(F.col("size") > most_rows)
        large = cut(sizes, f"large-{level}")
        if large.isEmpty():
            return placed
        placed, level = cut(_split(placed, large, most_rows, sample, level), f"placed-{level}"), level + 1


def _split(placed: DataFrame, large: DataFrame, most_rows: int, sample: int, level: int) -> DataFrame:
    at = F.xxhash64(F.lit(level), "cls") / F.lit(2.0**64) + 0.5
    parts = F.least(F.lit(MOST_PARTS), F.ceil(F.col("size") * 1.5 / most_rows)).cast("int")
    taken = placed.join(large, ["space", "path"]).filter(at < F.lit(float(sample)) / F.col("size")).select("space", "path", "cls", "size", parts.alias("parts"), "v")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (space, path), rows in by_shard(batches, ("space", "path")):
            n_parts = rows.column("parts")[0].as_py()
            centres = centres_of(matrix(rows.column("v").combine_chunks()), n_parts)
            yield pa.RecordBatch.from_arrays([pa.array([space]), pa.array([path]), pa.array([n_parts], pa.int32()), rows.column("size").combine_chunks()[:1], pa.array([centres.ravel().tolist()], pa.list_(pa.float64()))], names=["space", "path", "parts", "size", "centres"])

    fitted = cut(taken.repartition("space", "path").sortWithinPartitions("space", "path", "cls").mapInArrow(lean(fit), "space string, path string, parts int, size long, centres array<double>"), f"centres-{level}")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, paths, homes = _dealt(batch, level)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("cls").take(take), batch.column("space").take(take), pa.array(paths, pa.string()), pa.array(homes, pa.bool_()), batch.column("n").take(take), batch.column("v").take(take)],
                names=["cls", "space", "path", "home", "n", "v"],
            )

    joined = placed.join(fitted, ["space", "path"], "left")
    return joined.select("cls", "space", "path", "home", "n", "v", "parts", "size", "centres").mapInArrow(lean(deal), "cls long, space string, path string, home boolean, n long, v array<double>")


def _dealt(batch: pa.RecordBatch, level: int) -> tuple[list[int], list[str], list[bool]]:
    """Where the rows of a batch go: row number, path, and whether the row is at home there. Cells without ``parts`` stay."""
    rows: list[int] = []
    paths: list[str] = []
    homes: list[bool] = []
    spaces, old, home, parts = (batch.column(c).to_pylist() for c in ("space", "path", "home", "parts"))
    hashes = mix(batch.column("cls").to_numpy().astype(np.uint64), 40 + level).tolist()
    cells: dict[tuple[str, str], list[int]] = {}

    def put(i: int, path: str, at_home: bool) -> None:
        rows.append(i)
        paths.append(path)
        homes.append(at_home)

    for i, n_parts in enumerate(parts):
        if n_parts is None:
            put(i, old[i], home[i])
        else:
            cells.setdefault((spaces[i], old[i]), []).append(i)
    for (_, path), own in cells.items():
        n_parts, centres = parts[own[0]], np.array(batch.column("centres")[own[0]].as_py())
        if len(centres):
            x = matrix(batch.column("v").take(pa.array(own)))
            nearest = np.argsort(-(x @ centres.reshape(-1, x.shape[1]).T), 1, kind="stable")[:, :2]
            for i, ends in zip(own, nearest.tolist(), strict=True):
                for k, end in enumerate(ends if home[i] else ends[:1]):
                    put(i, f"{path}/{end}", home[i] and k == 0)
            continue
        shared = SHARED / batch.column("size")[own[0]].as_py()
        for i in own:
            mine = hashes[i] % n_parts
            for end in range(n_parts) if home[i] and hashes[i] / 2.0**64 < shared else (mine,):
                put(i, f"{path}/{end}", home[i] and end == mine)
    return rows, paths, homes


# --- graphs


def shards_of(placed: DataFrame) -> int:
    return placed.select("space", "path").distinct().count()


def in_shards(rows: DataFrame, keys: list[str], n_shards: int, *order: str) -> DataFrame:
    """Rows dealt to tasks by shard, each shard's together and in order. As many tasks as shards, since their work is not their bytes."""
    return rows.repartition(max(1, min(n_shards, 20_000)), *keys).sortWithinPartitions(*keys, *order)


def adjacency(placed: DataFrame, n_shards: int) -> DataFrame:
    """(cls, links array<long>): the graphs of all shards, built task by task and united by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_shard(batches, ("space", "path")):
            cls = rows.column("cls").to_numpy()
            graph = FlatGraph.build(matrix(rows.column("v").combine_chunks()).astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array([cls[own[own >= 0]].tolist() for own in graph.links], pa.list_(pa.int64()))], names=["cls", "links"])

    built = in_shards(placed.select("space", "path", "cls", "v"), ["space", "path"], n_shards, "cls").mapInArrow(lean(run), "cls long, links array<long>")
    return built.groupBy("cls").agg(F.array_distinct(F.flatten(F.collect_list("links"))).alias("links"))  # as many lists as a class has shards


class Shard:
    """What a task holds of one shard: its rows of the united graph, and the components its links make so far."""

    def __init__(self, rows: pa.Table, least: float):
        self.cls = rows.column("cls").to_numpy()  # sorted
        self.home = np.array(rows.column("home").to_pylist(), bool)
        self.n = rows.column("n").to_numpy()
        self.paths = rows.column("paths").to_pylist()
        self.exact = matrix(rows.column("v").combine_chunks())
        self.least, self.label = least, np.arange(len(self.cls))
        lists = rows.column("links").combine_chunks()
        ends = lists.flatten().to_numpy()
        own = np.repeat(np.arange(len(self.cls)), pa.compute.list_value_length(lists).to_numpy())
        at = np.minimum(np.searchsorted(self.cls, ends), len(self.cls) - 1)
        here = self.cls[at] == ends
        order = own[here]
        place = np.arange(len(order)) - np.searchsorted(order, order)
        width = int(place.max(initial=0)) + 1
        links = np.full((len(self.cls), width), -1, np.int32)
        links[order, place] = at[here]
        x = self.exact.astype(np.float32)
        self.graph = FlatGraph(x, links, int((x @ x.mean(0)).argmax()))

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins the components of the rows a and b, pair by pair."""
        label = self.label
        while True:
            low = np.minimum(label[a], label[b])
            if (label[a] == label[b]).all():
                break
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            while (label[label] != label).any():
                label = label[label]
        self.label = label

    def search(self, path: str, cls: np.ndarray, exact: np.ndarray, paths: list[list[str]], starts: np.ndarray | None, beam: int) -> tuple[list, list, list]:
        """For a block of queries: (cls, links at home here), (a, b) links to keep, (cls, path, start) of shards to go on in."""
        at = np.searchsorted(self.cls, cls)
        at = np.where(self.cls[np.minimum(at, len(self.cls) - 1)] == cls, at, -1)
        begin = None if starts is None else (np.flatnonzero(starts >= 0), starts[starts >= 0])
        sims = self.graph.search(exact.astype(np.float32), beam, self.least - 1e-4, begin)
        q, c = np.nonzero(sims >= self.least - 1e-4)
        sure = np.einsum("nd,nd->n", exact[q], self.exact[c]) >= self.least
        q, c = q[sure & (c != at[q])], c[sure & (c != at[q])]
        found = np.bincount(q, self.n[c] * self.home[c], len(cls)).astype(np.int64)
        first = np.flatnonzero(np.diff(q, prepend=-1))  # each query's first row in range
        mine = np.full(len(cls), -1)
        mine[q[first]] = c[first]
        own = np.where(at >= 0, at, mine)
        self.merge(own[q], c)
        links = [(int(cls[i]), int(self.cls[mine[i]])) for i in np.flatnonzero((at < 0) & (mine >= 0)).tolist()]
        routes = []
        for i, rows in enumerate(np.split(c, np.searchsorted(q, np.arange(1, len(cls))))):
            if len(rows):
                known, new = {path, *paths[i]}, {}
                for k in rows.tolist():
                    for p in self.paths[k]:
                        if p not in known:
                            new.setdefault(p, int(self.cls[k]))
                routes += [(int(cls[i]), p, start) for p, start in new.items()]
        return list(zip(cls.tolist(), found.tolist(), strict=True)), links, routes

    def forest(self) -> list[tuple[int, int]]:
        apart = np.flatnonzero(self.label != np.arange(len(self.cls)))
        return list(zip(self.cls[apart].tolist(), self.cls[self.label[apart]].tolist(), strict=True))


_FOUND = "kind string, a long, b long, path string"


def _made(kind: str, rows: list[tuple], with_path: bool = False) -> pa.RecordBatch:
    a, b = [r[0] for r in rows], [r[2] if with_path else r[1] for r in rows]
    paths = [r[1] if with_path else None for r in rows]
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(paths, pa.string())], names=["kind", "a", "b", "path"])


def _searched(shard: Shard, path: str, visits: Iterator[tuple], beam: int) -> Iterator[pa.RecordBatch]:
    for visit in visits:
        counts, links, routes = shard.search(path, *visit, beam)
        yield _made("count", counts)
        yield _made("link", links)
        yield _made("route", routes, True)
    yield _made("link", shard.forest())


def search_at_home(graph: DataFrame, n_shards: int, least: float, beam: int) -> DataFrame:
    """Every member of a shard searched for in it: count (cls, links), link (cls, cls) and route (cls, start, path) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, path), rows in by_shard(batches, ("space", "path")):
            shard = Shard(rows, least)
            blocks = ((slice(i, i + QUERIES)) for i in range(0, len(shard.cls), QUERIES))
            yield from _searched(shard, path, ((shard.cls[b], shard.exact[b], shard.paths[b], None) for b in blocks), beam)

    return in_shards(graph, ["space", "path"], n_shards, "cls").mapInArrow(lean(run), _FOUND)


def search_away(graph: DataFrame, visits: DataFrame, n_shards: int, least: float, beam: int) -> DataFrame:
    """As ``search_at_home`` for ``visits`` (space, path, cls, v, paths, start) of classes that are not in the shard.

    Shards with many visits are sent to several tasks, each with some of the visits.
    """
    many = cut(visits.groupBy("space", "path").agg(F.ceil(F.count("*") / MOST_VISITS).alias("salts")), "salts")
    columns = ["space", "path", "salt", "start", "cls", "home", "n", "v", "paths", "links"]
    salted = visits.join(many, ["space", "path"]).withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("salts")))
    there = graph.join(many, ["space", "path"]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    none = F.lit(None)
    members = there.withColumn("start", F.lit(-1).cast("long")).select(columns)  # sorts before all visits
    guests = salted.select("space", "path", "salt", "start", "cls", none.cast("boolean").alias("home"), none.cast("long").alias("n"), "v", "paths", none.cast("array<long>").alias("links"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, path, _), rows in by_shard(batches, ("space", "path", "salt")):
            own = rows.filter(pa.compute.equal(rows.column("start"), -1))
            guests = rows.slice(own.num_rows)
            shard = Shard(own, least)

            def blocks(guests: pa.Table = guests, shard: Shard = shard) -> Iterator[tuple]:
                for i in range(0, guests.num_rows, QUERIES):
                    part = guests.slice(i, QUERIES)
                    yield part.column("cls").to_numpy(), matrix(part.column("v").combine_chunks()), part.column("paths").to_pylist(), np.searchsorted(shard.cls, part.column("start").to_numpy())

            yield from _searched(shard, path, blocks(), beam)

    together = in_shards(members.unionByName(guests), ["space", "path", "salt"], n_shards, "start", "cls")
    return together.mapInArrow(lean(run), _FOUND)


def links_of(placed: DataFrame, graph: DataFrame, classes: DataFrame, n_shards: int, least: float, beam: int) -> tuple[DataFrame, DataFrame]:
    """(cls, links) with the rows linked to each class, and (a, b) links that join what belongs together."""
    found = cut(search_at_home(graph, n_shards, least, beam), "found-0")
    every, turn = [found], 0
    seen = placed.select("cls", "path")
    while True:
        wanted = found.filter("kind = 'route'").groupBy(F.col("a").alias("cls"), "path").agg(F.min("b").alias("start"))
        new = cut(wanted.join(seen, ["cls", "path"], "left_anti"), f"new-{turn}")
        if new.isEmpty():
            break
        seen = cut(seen.unionByName(new.select("cls", "path")), f"seen-{turn}")
        known = cut(seen.join(new.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.collect_set("path").alias("paths")), f"known-{turn}")  # shards a class has been to
        visits = new.join(classes.select("cls", "space", "v"), "cls").join(known, "cls")
        turn += 1
        found = cut(search_away(graph, visits, n_shards, least, beam), f"found-{turn}")
        every.append(found)
    rows = every[0]
    for more in every[1:]:
        rows = rows.unionByName(more)
    counts = cut(rows.filter("kind = 'count'").groupBy(F.col("a").alias("cls")).agg(F.sum("b").alias("links")), "counts")
    return counts, rows.filter("kind = 'link'").select("a", "b").distinct()


def audit(classes: DataFrame, counts: DataFrame, least: float, most: int = AUDIT) -> float:
    """The share of links found, by brute force for ``most`` classes at most, half of them among those with links, against all rows."""
    both = classes.select("cls", "space", "v").join(counts, "cls")
    some = both.orderBy(F.xxhash64(F.lit("audit"), "cls")).limit(most // 2).unionByName(both.filter("links > 0").orderBy(F.xxhash64(F.lit("linked"), "cls")).limit(most // 2))
    asked = {r["cls"]: r for r in some.collect()}  # a stated number of vectors
    if not asked:
        return 1.0
    spaces: dict[str, tuple] = {}
    for r in asked.values():
        spaces.setdefault(r["space"], []).append((r["cls"], r["v"]))
    sent = classes.sparkSession.sparkContext.broadcast({s: (np.array([c for c, _ in own]), matrix(pa.array([v for _, v in own]))) for s, own in spaces.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = np.array(batch.column("space").to_pylist(), object)
            cls, n = batch.column("cls").to_numpy(), batch.column("n").to_numpy()
            for space in set(given.tolist()) & set(sent.value):
                names, q = sent.value[space]
                at = np.flatnonzero(given == space)
                near = (q @ matrix(batch.column("v").take(pa.array(at))).T >= least) & (cls[at][None, :] != names[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(near @ n[at])], names=["cls", "links"])

    true = classes.select("cls", "space", "n", "v").mapInArrow(lean(run), "cls long, links long").groupBy("cls").agg(F.sum("links").alias("links")).collect()
    total = sum(r["links"] for r in true)
    return sum(min(r["links"], asked[r["cls"]]["links"]) for r in true) / total if total else 1.0


def near_duplicates(
    rows: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", most_rows: int = MOST_ROWS, beam: int = BEAM, audited: Callable[[int, float], None] | None = None
) -> DataFrame:
    """One row per row: id, n_links, component_id (the least id reachable), kept. ``audited`` is told each beam and its recall."""
    marked, classes = classes_of(rows, id_col, vector, label)
    placed = place(classes, most_rows)
    n_shards = shards_of(placed)
    paths = placed.groupBy("cls").agg(F.collect_list("path").alias("paths"))  # one more than the levels
    graph = cut(placed.join(cut(paths, "paths"), "cls").join(cut(adjacency(placed, n_shards), "adjacency"), "cls"), "graph")
    while True:
        counts, links = links_of(placed, graph, classes, n_shards, least, beam)
        recall = audit(classes, counts, least)
        if audited:
            audited(beam, recall)
        if recall >= LEAST_RECALL or beam >= MOST_BEAM:
            break
        beam *= 2
    state = components(cut(classes.select(F.col("cls").alias("node"), F.col("cls").alias("comp")), "nodes"), cut(links, "links"))
    named = classes.join(state.select(F.col("node").alias("cls"), "comp"), "cls").join(counts, "cls")
    least_of = cut(named.groupBy("comp").agg(F.min("least").alias("component_id")), "names")
    answer = cut(named.join(least_of, "comp").select("space", "h1", "h2", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id"), "answer")
    joined = cut(marked, "marked").join(answer, ["space", "h1", "h2"], "left")
    return joined.select("id", F.coalesce("n_links", F.expr("0L")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
