"""MinHash near-dedup with circulant signatures, banding and exact verification on full sets.

1. One pass over the texts: words, five-word shingles, the set's 64-bit fingerprint and its signature. The signature is
   circulant: one permutation (sigma) places a shingle among 2**22 positions, a second one (pi) is shifted by one position
   per coordinate, so a shingle's values for all coordinates are one slice of pi's table, and the signature is the
   minimum of the slices, of which the low bytes are kept. 640 coordinates in 80 bands of 8 miss a pair of similarity
   0.75 twice in 10,000 and one of 0.8 less than once in a million.
2. Documents of equal fingerprints (128 bits) are one class with one row, its signature beside it. Only classes are
   banded, so copies, however many, are never rows of a bucket.
3. Band keys with more than one class are buckets; a bitmap of them keeps all other band rows from moving again. In every
   bucket each class is paired with one centre; the centres are the same for a group in most of its buckets, so there are
   few different pairs. Signatures rule out pairs far below the threshold (estimate under 0.67 where 0.75 is wanted: 4.7
   standard deviations), the rest are confirmed on full sets.
4. Confirmed links give components. Buckets whose members are not all in one component go round again, from the
   bucket's largest component. What still is apart is compared in full: the members of such a bucket, in blocks of
   ``BLOCK``, signature against signature. First only each node's likeliest partner is confirmed; after that has merged
   what belongs together, every pair of different components that may be a link is confirmed in its first common band.
   So no pair of a bucket is left out unless its ends are linked already, and only links become rows.
5. Blocks of a bucket with more than ``HOT`` members apart would be many: such members, unlike each other but for a passage
   that very many share, are dealt again by their rarest shingles. Sets of similarity t have one in common among the
   n - ceil(t * n) + 1 rarest of each, in any fixed order, so this loses no link; a passage of many is in no set's rarest.

Full sets are computed again only for the classes that have to be confirmed; a bitmap of their ids picks their rows, so texts
are not shuffled. Bitmaps are sized by the number of keys, 8 MB at most. Links and components stay distributed; every
loop's state is a table in the shared folder.

Defined cases: null text, and text without words: an empty set, linked with nothing; fewer words than a shingle: the
whole sequence is the one shingle; a text of any length is read whole, in pieces of 1 MB; repeated rows and rows of one id are
linked if their sets are; a null id counts as larger than any other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketspark.llm.common import bitmap, bits_for, claim, ended_buffer, filled, in_bitmap, lean, long_text, mix, pieces, slices, word_hashes, word_spans
from docketspark.session import cut

WORDS = 5
BANDS, ROWS = 80, 8
COORDINATES = BANDS * ROWS
LOG2_PLACES = 22
LEAST_ESTIMATE = 0.67
ROUNDS = 3
BLOCK = 512
BLOCK_SHINGLES = 1 << 20
HOT = 8192

_U = np.uint64
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

def pi_slices() -> np.ndarray:
    """Row p: pi at p, p + 1, ... around the circle, for all coordinates. A view of one table of 2**22 values."""
    kept = claim("minhash")
    if "pi" not in kept:
        places = 1 << LOG2_PLACES
        pi = np.random.default_rng(20240607).permutation(places).astype(np.uint32)
        kept["pi"] = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:COORDINATES]]), COORDINATES)
    return kept["pi"]


def signature(shingles: np.ndarray, block: int = 1024) -> np.ndarray:
    table = pi_slices()
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    places = (mix(shingles, 11) >> _U(64 - LOG2_PLACES)).astype(np.int64)
    for k in range(0, len(places), block):
        np.minimum(out, table[places[k : k + block]].min(0), out)
    return out


def _rolled(hashes: np.ndarray, words: int) -> np.ndarray:
    """Hashes of all runs of ``words`` words."""
    rolled = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for k in range(words):
        rolled += mix(hashes[k : k + len(rolled)], k + 1)
    return mix(rolled, words)


def _whole(hashes: np.ndarray) -> np.ndarray:
    """The one shingle of a text with fewer words than a shingle; none without words."""
    total = np.zeros(1, np.uint64)
    for k in range(len(hashes)):
        total += mix(hashes[k : k + 1], k + 1)
    return mix(total, 100 + len(hashes)) if len(hashes) else np.zeros(0, np.uint64)


def _long_set(data: np.ndarray, words: int) -> np.ndarray:
    """The set of one long text, piece by piece; the last words of a piece go on to the next."""
    parts, held = [], np.zeros(0, np.uint64)
    for a, b in pieces(data, _SEPARATOR):
        piece = np.append(_LOWER[data[a:b]], np.uint8(10))
        hashes = np.concatenate([held, word_hashes(piece, *word_spans(_SEPARATOR[piece]))])
        parts.append(np.unique(_rolled(hashes, words)))
        held = hashes[max(0, len(hashes) - words + 1) :]
    return np.unique(np.concatenate(parts)) if any(map(len, parts)) else _whole(held)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles."""
    for i, j in slices(texts):
        if (long := long_text(texts, i, j)) is not None:
            yield _long_set(long, words)
            continue
        data, offsets = ended_buffer(texts.slice(i, j - i))
        data = _LOWER[data]
        starts, ends = word_spans(_SEPARATOR[data])
        hashes = word_hashes(data, starts, ends)
        bounds = np.searchsorted(starts, offsets)
        rolled = _rolled(hashes, words)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield np.unique(rolled[a : b - words + 1]) if b - a >= words else _whole(hashes[a:b])


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over the set, independent of its order."""
    return tuple(int(mix(shingles, seed).sum(dtype=np.uint64).astype(np.int64)) for seed in (21, 22)) if len(shingles) else (0, 0)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Per row: id, n_shingles, node and check (the set's fingerprint), sig (the coordinates' low bytes), and maybe the text's digest."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([_digest(text_col).alias("digest")] if digests else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, checks, sigs = [], [], [], []
            for s in shingle_sets(filled(batch.column("text"))):
                sizes.append(len(s))
                a, b = fingerprint(s)
                nodes.append(a)
                checks.append(b)
                sigs.append(signature(s).astype(np.uint8).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(checks, pa.int64()), pa.array(sigs, pa.binary()), *batch.columns[2:]],
                names=["id", "n_shingles", "node", "check", "sig", *batch.schema.names[2:]],
            )

    return rows.mapInArrow(lean(run), f"id {rows.schema['id'].dataType.simpleString()}, n_shingles long, node long, check long, sig binary" + ", digest string" * digests)


def bands_of(sig) -> list:
    """Columns band and bucket, one row a band."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.struct(k.alias("band"), F.xxhash64(k, F.substring(sig, k * ROWS + 1, F.lit(ROWS))).alias("bucket")))
    return F.inline(keys)


def full_sets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Per row: node and check (the set's fingerprint), shingles (sorted, 8 bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, sets = [], []
            for s in shingle_sets(filled(batch.column("text"))):
                marks.append(fingerprint(s))
                sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([*(pa.array([m[k] for m in marks], pa.int64()) for k in range(2)), pa.array(sets, pa.binary())], names=["node", "check", "shingles"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(lean(run), "node long, check long, shingles binary")


def _likely(pairs: DataFrame, least: float = LEAST_ESTIMATE) -> DataFrame:
    """Of pairs (a, b, sig_a, sig_b) those whose signatures agree often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, COORDINATES) for c in ("sig_a", "sig_b"))
            keep = pa.array((left == right).mean(1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return pairs.mapInArrow(lean(run), "a long, b long")


def _apart_in_blocks(members: DataFrame, share: tuple[int, int], least: float = LEAST_ESTIMATE, banded: bool = True) -> DataFrame:
    """Pairs (a, b) of different components in one bucket, from cells of two blocks at most. ``banded``: buckets are of bands.

    ``members``: bucket, i, j, side (0: block i, 1: block j), band, node, comp, n, sig and maybe shingles, sorted by cell, so a
    task holds one cell at a time. Without shingles: each node's likeliest partner, to be confirmed. With them: links, confirmed
    here on full sets, the likeliest first and none between what the cell has linked by then.
    """
    exact = "shingles" in members.columns
    fixed = ("side", "band", "node", "comp", "n")

    def joined(a: int, b: int, shingles: list) -> bool:
        both = len(np.intersect1d(shingles[a], shingles[b], assume_unique=True))
        return share[0] * both >= share[1] * (len(shingles[a]) + len(shingles[b]) - both)

    def pairs_in(cell: list) -> tuple[list[int], list[int]]:
        side, band, node, comp, n, sig = (np.concatenate([c[k] for c in cell]) for k in range(6))
        shingles = [np.frombuffer(x, np.uint64) for c in cell for x in c[6]] if exact else []
        comp = comp.copy()
        inner = not side.any()
        right = np.flatnonzero(side == 1)
        a, b = [], []

        def keep(x: int, y: int) -> None:
            a.append(min(node[x], node[y]))
            b.append(max(node[x], node[y]))

        for x in np.flatnonzero(side == 0).tolist():
            others = np.arange(x) if inner else right
            others = others[(comp[others] != comp[x]) & (share[0] * np.minimum(n[others], n[x]) >= share[1] * np.maximum(n[others], n[x]))]
            if not len(others):
                continue
            same = sig[others] == sig[x]
            agree = same.mean(1)
            if not exact:
                if agree.max() >= least:
                    keep(x, others[agree.argmax()])
                continue
            near = np.flatnonzero(agree >= least)
            # a pair belongs to its first common band, so that no other bucket looks at it again
            if banded:
                near = near[same[near].reshape(-1, BANDS, ROWS).all(2).argmax(1) == band[x]]
            for y in others[near[np.argsort(-agree[near], kind="stable")]].tolist():
                if comp[y] != comp[x] and joined(x, y, shingles):
                    keep(x, y)
                    comp[comp == comp[y]] = comp[x]
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: list = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("bucket", "i", "j")], 1)
            columns: list = [batch.column(c).to_numpy() for c in fixed]
            columns.append(np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(-1, COORDINATES))
            if exact:
                columns.append(batch.column("shingles").to_pylist())
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            a, b = [], []
            for p, q in zip(edges, edges[1:], strict=False):
                if key is not None and tuple(keys[p]) != key:
                    x, y = pairs_in(cell)
                    a += x
                    b += y
                    cell = []
                key = tuple(keys[p])
                cell.append([c[p:q] for c in columns])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        if cell:
            a, b = pairs_in(cell)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return members.mapInArrow(lean(run), "a long, b long")


def _confirmed(pairs: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Of pairs (a, b, set_a, set_b) those with share[0] * intersection >= share[1] * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(share[0] * both >= share[1] * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return pairs.mapInArrow(lean(run), "a long, b long")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, comp) for all ``nodes`` (node, comp so far), after the components that ``links`` (a, b) join have merged.

    Boruvka's contraction over the components so far: in each round every component that has an edge takes its least one, by
    a hash of both ends that is new in each round, and what these edges join becomes one. That at least halves the components
    that have edges, whatever their labels and the length of chains, so rounds are logarithmic and end when no edge is left.
    All states are written tables.
    """
    ends = links.join(nodes.select(F.col("node").alias("a"), F.col("comp").alias("x")), "a").join(nodes.select(F.col("node").alias("b"), F.col("comp").alias("y")), "b").filter("x != y").select("x", "y")
    edges = cut(ends.union(ends.select("y", "x")).distinct(), "edges")
    if edges.isEmpty():
        return nodes
    label = None
    turn = 0
    while not edges.isEmpty():
        low, high = F.least("x", "y"), F.greatest("x", "y")
        least = edges.groupBy("x").agg(F.min(F.struct(F.xxhash64(F.lit(turn), low, high).alias("weight"), low.alias("low"), high.alias("high"), F.col("y").alias("to"))).alias("edge"))
        taken = cut(least.select("x", F.col("edge.to").alias("to")), "taken")
        # least edges make no circle but that of two ends that take the same edge: the lesser end is the root
        back = taken.join(taken.select(F.col("x").alias("to"), F.col("to").alias("back")), "to")
        root = cut(back.select("x", F.when((F.col("back") == F.col("x")) & (F.col("x") < F.col("to")), F.col("x")).otherwise(F.col("to")).alias("to")), "roots")
        while True:  # pointer jumping, which halves the depth
            jumped = root.join(root.select(F.col("x").alias("to"), F.col("to").alias("far")), "to").select("x", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved"))
            jumped = cut(jumped, "roots")
            root = jumped.select("x", "to")
            if jumped.filter("moved").isEmpty():
                break
        if label is None:
            label = root
        else:
            step = root.select(F.col("x").alias("to"), F.col("to").alias("next"))
            label = cut(label.join(step, "to", "left").select("x", F.coalesce("next", "to").alias("to")), "labels")
        from_x, from_y = root.select("x", F.col("to").alias("new_x")), root.select(F.col("x").alias("y"), F.col("to").alias("new_y"))
        edges = cut(edges.join(from_x, "x").join(from_y, "y").filter("new_x != new_y").select(F.col("new_x").alias("x"), F.col("new_y").alias("y")).distinct(), "edges")
        turn += 1
    least = cut(label.groupBy("to").agg(F.min("x").alias("merged")), "least")
    merged = label.join(least, "to").select(F.col("x").alias("comp"), "merged")
    return cut(nodes.join(merged, "comp", "left").select("node", F.coalesce("merged", "comp").alias("comp")), "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: tuple[int, int] = (100, 75), rounds: int = ROUNDS, hot: int = HOT) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (the least id reachable), kept."""
    rows, classes = _grouped(docs, id_col, text_col, share, rounds, hot)
    named = cut(classes.groupBy("comp").agg(F.min("least").alias("component_id")), "names")
    answer = cut(classes.join(named, "comp").select("node", "check", "component_id"), "answer")
    wordy = F.col("n_shingles") > 0
    plain = rows.select("id", "n_shingles", F.when(wordy, F.col("node")).alias("node"), "check")
    joined = plain.join(answer, ["node", "check"], "left").select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    return joined.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with exactly one row of each component, one with the least id (null is larger than any). All columns stay.

    Decisions are by row, not by id: rows of equal ids and different texts are different documents. Only rows that a
    bitmap of the marked rows' ids lets pass are shuffled for the exact answer; the others go straight through.
    """
    rows, classes = _grouped(docs, id_col, text_col, digests=True)
    # written first: joins right above an aggregate are ones whose hot partitions adaptive execution does not split
    found = cut(rows.filter("n_shingles > 0").select("id", "digest", "node", "check").join(cut(classes.select("node", "check", "comp"), "answer"), ["node", "check"]).select("id", "digest", "comp"), "found")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "digest")).alias("first")
    groups = cut(found.groupBy("comp").agg(first, F.count("*").alias("n")).filter("n > 1").select("comp", F.col("first.id").alias("first_id"), F.col("first.digest").alias("first_digest")), "groups")
    stays = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("digest") == F.col("first_digest"))
    marked = cut(found.join(groups, "comp").select("id", "digest", stays.alias("stays")).groupBy("id", "digest", "stays").agg(F.count("*").alias("n")).filter("n > 1 or not stays"), "marked")
    log2_bits = bits_for(marked.count())
    maybe = in_bitmap(bitmap(marked, F.xxhash64("id"), log2_bits).scalar(), F.xxhash64(F.col(id_col)), log2_bits)
    suspects = docs.filter(maybe).select(F.struct("*").alias("row"), F.col(id_col).alias("own_id"), _digest(text_col).alias("own"))

    def same(part: DataFrame):
        return suspects["own_id"].eqNullSafe(part["id"]) & (suspects["own"] == part["digest"])

    gone, repeated = marked.filter("not stays"), marked.filter("stays")
    left = suspects.join(gone, same(gone), "left_anti")
    if not repeated.isEmpty():  # rows equal in id and text, one of which stays
        left = left.join(repeated, same(repeated), "left_anti").unionByName(left.join(repeated, same(repeated), "left_semi").dropDuplicates(["own_id", "own"]))
    return docs.filter(~maybe).unionByName(left.select("row.*"))


def _digest(text_col: str) -> Column:
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)


def _grouped(
    docs: DataFrame, id_col: str, text_col: str, share: tuple[int, int] = (100, 75), rounds: int = ROUNDS, hot: int = HOT, digests: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows, and per class (node, check) of equal sets its component (comp) and its least id (least)."""
    rows = cut(sketches(docs, id_col, text_col, digests), "sketches")
    grouped = rows.filter("n_shingles > 0").groupBy("node", "check").agg(F.min("id").alias("least"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    classes = cut(grouped.withColumn("cls", F.monotonically_increasing_id()), "classes")  # a number of its own, once written
    bands = classes.select("cls", bands_of(F.col("sig")))
    full = cut(bands.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket"), "buckets")
    log2_bits = bits_for(full.count())
    passing = cut(bands.filter(in_bitmap(bitmap(full, F.col("bucket"), log2_bits).scalar(), F.col("bucket"), log2_bits)), "passing")
    # a class' number is given without regard to its set, so the least one is as good as a random centre
    shared = cut(passing.groupBy("bucket").agg(F.min("cls").alias("centre"), F.max("cls").alias("last")).filter("centre != last").select("bucket", "centre"), "shared")
    # written first: a join right above an aggregate is one whose hot partitions adaptive execution does not split
    members = cut(passing.join(shared, "bucket").select("bucket", "band", F.col("cls").alias("node"), "centre"), "members")
    known = cut(classes.withColumnRenamed("node", "sum").withColumnRenamed("cls", "node").join(members.select("node").distinct(), "node", "left_semi"), "candidates")
    sig = known.select("node", "sig", "n")

    # full sets of the candidates, from the rows the bitmap lets pass
    log2_ids = bits_for(known.count())
    picked = docs.filter(in_bitmap(bitmap(known, F.xxhash64("least"), log2_ids).scalar(), F.xxhash64(F.col(id_col)), log2_ids))
    marks = known.select(F.col("sum").alias("node"), "check", F.col("node").alias("cls"))
    sets = cut(full_sets(picked, text_col).dropDuplicates(["node", "check"]).join(marks, ["node", "check"]).select(F.col("cls").alias("node"), "shingles"), "sets")

    def likely(pairs: DataFrame, name: str) -> DataFrame:
        fits = (share[0] * F.least("n_a", "n_b")) >= (share[1] * F.greatest("n_a", "n_b"))
        with_a = pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"), F.col("n").alias("n_a")), "a")
        with_b = with_a.join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"), F.col("n").alias("n_b")), "b")
        return cut(_likely(with_b.filter(fits).select("a", "b", "sig_a", "sig_b")), f"likely-{name}")

    def confirm(pairs: DataFrame, name: str) -> DataFrame:
        full = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
        return cut(_confirmed(full.select("a", "b", "set_a", "set_b"), share), f"links-{name}")

    def compared(rows_of: DataFrame, exact: bool, banded: bool = True) -> DataFrame:
        """Pairs found among the members (bucket, band, node, comp, n, sig, blocks and maybe shingles), cell by cell."""
        carried = ["bucket", "band", "node", "comp", "n", "sig", *(["shingles"] if exact else [])]
        placed = rows_of.select(*carried, F.pmod(F.xxhash64("node"), F.col("blocks")).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
        cells = placed.select(*carried, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
        return _apart_in_blocks(cells.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j"), share, banded=banded)

    def with_blocks(rows_of: DataFrame) -> DataFrame:
        """With sets, and as many blocks as make members and shingles of one fit a task."""
        weight = rows_of.groupBy("bucket").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
        return rows_of.join(weight, "bucket").join(sets, "node")

    ends = [F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")]
    tested = likely(members.filter("node != centre").select(*ends).distinct(), "0")
    state = components(cut(known.select("node", F.col("node").alias("comp")), "nodes"), confirm(tested, "0"))
    apart = members.select("bucket", "band", "node")
    for k in range(1, rounds + 1):
        apart = apart.join(state, "node")
        split = apart.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n_members")).filter("low != high").select("bucket", "n_members")
        apart = cut(apart.join(cut(split, "split"), "bucket").select("bucket", "band", "node", "comp", "n_members"), f"apart-{k}")
        if apart.isEmpty():
            break
        if k == 1:
            largest = (
                apart.groupBy("bucket", "comp")
                .agg(F.count("*").alias("n"), F.max("node").alias("one"))
                .groupBy("bucket")
                .agg(F.max(F.struct("n", "comp", "one")).alias("top"))
                .select("bucket", F.col("top.comp").alias("main"), F.col("top.one").alias("centre"))
            )
            pairs = apart.join(largest, "bucket").filter("comp != main").select(*ends).distinct()
            pairs = likely(pairs.join(tested, ["a", "b"], "left_anti"), str(k))
        else:
            crowded = apart.filter(F.col("n_members") > hot).select("node", "comp").distinct()
            if k == 2 and not crowded.isEmpty():
                few = cut(_by_rarest(crowded, sets, sig, share), "rarest")
                state = components(state, cut(compared(with_blocks(few), exact=True, banded=False), "links-rarest"))
                apart = apart.drop("comp").join(state, "node")
            rows_of = apart.filter(F.col("n_members") <= hot).join(sig, "node")
            if k == rounds:
                state = components(state, cut(compared(with_blocks(rows_of), exact=True), "links-rest"))
                break
            found = compared(rows_of.withColumn("blocks", F.ceil(F.col("n_members") / BLOCK)), exact=False)
            pairs = cut(found.distinct().join(tested, ["a", "b"], "left_anti"), "likely-rest")
        tested = tested.union(pairs)
        state = components(state, confirm(pairs, str(k)))
        apart = apart.select("bucket", "band", "node")

    by_class = classes.select("node", "check", "least", "cls").join(state.select(F.col("node").alias("cls"), "comp"), "cls", "left")
    return rows, by_class.select("node", "check", "least", F.coalesce("comp", "cls").alias("comp"))


def _by_rarest(members: DataFrame, sets: DataFrame, sig: DataFrame, share: tuple[int, int]) -> DataFrame:
    """``members`` (node, comp) dealt by the rarest shingles of their sets: bucket, band (0), node, comp, n, sig.

    Rarity is counted among ``members``. Of a set of n, the n - ceil(t * n) + 1 rarest shingles are taken, of those the
    ones that another member has: two sets of similarity t have one of them in common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, comp, shingles in zip(*(batch.column(c).to_pylist() for c in ("node", "comp", "shingles")), strict=True):
                own = np.frombuffer(shingles, np.int64)
                for k in range(0, len(own), 1 << 16):
                    part = own[k : k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), v)) for v in (node, comp, len(own))] + [pa.array(part)], names=["node", "comp", "n", "shingle"])

    each = cut(members.join(sets, "node").mapInArrow(lean(run), "node long, comp long, n long, shingle long"), "shingles")
    counts = cut(each.groupBy("shingle").agg(F.count("*").alias("owners")), "owners")
    order = W.partitionBy("node").orderBy("owners", "shingle")
    ranked = each.join(counts, "shingle").withColumn("place", F.row_number().over(order))
    first = F.expr(f"n * {share[0] - share[1]} div {share[0]}") + 1
    few = ranked.filter((F.col("place") <= first) & (F.col("owners") > 1)).select(F.col("shingle").alias("bucket"), F.lit(0).alias("band"), "node", "comp")
    return few.join(sig, "node")
