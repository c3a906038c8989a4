"""Source divergence, vectors' near copies and resampling against brute force, and cases of hot keys in earlier operators."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docketspark.llm import divergence, embedding_dedup, graph, quality, resample, secrets, url_filter
from docketspark.llm.common import prepare
from docketspark.session import ship

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    prepare(spark)
    ship(spark)


# --- 11: source divergence


def plain_divergence(rows, least_docs, smoothing=5, most=50):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    counts, docs, groups = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = term.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        for w in words:
            counts[lang, source, w] += 1
        for w in set(words):
            docs[lang, w] += 1
    out = []
    for lang, sources in groups.items():
        kept = sorted((w for (x, w), n in docs.items() if x == lang and n >= least_docs), key=lambda w: w.encode())

        def shares(n, kept=kept):
            total = sum(n) + smoothing * len(kept)
            return [1 + 10**9 * (c + smoothing) // total for c in n]

        own = {s: [counts[lang, s, w] for w in kept] for s in sources}
        p = {s: shares(n) for s, n in own.items()}
        q = shares([sum(own[s][k] for s in sources) for k in range(len(kept))])
        for s in sources:
            pairs = [(sum(abs(a - b) for a, b in zip(p[s], p[o], strict=True)), o) for o in sources if o != s]
            terms = [(p[s][k] - q[k], w) for k, w in enumerate(kept) if own[s][k] and p[s][k] > q[k]]
            for part, found, limit in (("pair", pairs, len(pairs)), ("term", terms, most)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(found[:limit], 1)]
    return sorted(out)


@pytest.mark.parametrize(("chunk", "sent"), [(1024, 4 << 20), (7, 4 << 20), (7, 0)], ids=["one chunk", "chunks", "joined"])
def test_divergence_against_brute_force(spark, monkeypatch, chunk, sent):
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    monkeypatch.setattr(divergence, "MOST_SENT", sent)
    rng = random.Random(3)
    words = ["a", "É", "é", "zz", "Zz", "日本", "b" * 300, *(f"w{chr(97 + i)}" for i in range(20))]
    rows = [(rng.choice(["en", "fr", "", None]), rng.choice(["s0", "s0", "s0", "s1", "É", None, ""]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for _ in range(150)]
    rows += [("en", "silent", None), ("en", "silent", "12 !"), ("xx", "only", "rare"), ("yy", "a", None), ("yy", "b", ""), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").select("*", *[F.lit("clash").alias(c) for c in ("term", "n", "chunk", "item", "value", "kind", "doc_id")]).repartition(3)
    got = sorted(tuple(r) for r in divergence.source_divergence(docs, least_docs=4, most_terms=5).collect())
    assert got == plain_divergence(rows, 4, most=5)
    assert divergence.source_divergence(docs.limit(0)).count() == 0


def test_counts_of_long_texts_are_whole(spark):
    long = "Alpha beta " * 150_000 + "x" * 1_200_000
    docs = spark.createDataFrame([("en", "s", long), ("en", "s", "alpha")], "lang string, source string, text string")
    assert {tuple(r) for r in divergence.counted(docs).collect()} == {("en", "s", "alpha", 150_001, 2), ("en", "s", "beta", 150_000, 1), ("en", "s", "x" * 1_200_000, 1, 1)}


def test_shares_are_exact():
    rng = random.Random(1)
    total = [rng.randint(1, 10**15) for _ in range(500)]
    count = [rng.randint(0, t) for t in total]
    assert divergence.share(np.array(count), np.array(total)).tolist() == [10**9 * c // t for c, t in zip(count, total, strict=True)]


# --- 12: near copies of vectors


def plain_components(vectors, links):
    parent = list(range(len(vectors)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return [root(a) for a in range(len(vectors))]


def held_against_brute_force(spark, vectors, labels, **options):
    """Share of links found; none may be more than brute force has."""
    x = np.array(vectors, float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(near, False)
    rows = spark.createDataFrame([(i, [float(c) for c in v], k) for i, (v, k) in enumerate(zip(vectors, labels, strict=True))], "vec_id long, embedding array<double>, label int").repartition(4)
    told = []
    got = {r["id"]: r for r in embedding_dedup.near_duplicates(rows, audited=lambda *x: told.append(x), **options).collect()}
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert len(got) == len(x) and (found <= near.sum(1)).all() and told[-1][1] >= 0.95
    expected = plain_components(vectors, zip(*np.nonzero(near), strict=True))
    same = np.mean([got[i]["component_id"] == expected[i] for i in range(len(x))])
    return found.sum() / max(1, near.sum()), same


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 24))
    made = [rng.normal(size=24) for _ in range(300)]
    for k, n in enumerate([1, 2, 2, 3, 5, 9, 60, 150, *[2] * 22]):
        made += [centres[k] + 0.1 * rng.normal(size=24) for _ in range(n)]
    made += [made[0]] * 40 + [made[5], 3 * made[6]]  # copies and a scaled copy
    chain = [np.concatenate([[np.cos(a), np.sin(a)], np.zeros(22)]) for a in np.arange(0, 3, 0.3)]
    made += chain
    recall, same = held_against_brute_force(spark, made, [i % 2 for i in range(len(made))], most_rows=64)
    assert recall >= 0.99 and same >= 0.99


def test_a_group_that_clusters_do_not_divide_is_dealt_by_hash(spark):
    rng = np.random.default_rng(8)
    made = [np.ones(8) * (i + 1) + 1e-9 * rng.normal(size=8) for i in range(400)] + [rng.normal(size=8) for _ in range(50)]
    recall, same = held_against_brute_force(spark, made, [1] * len(made), most_rows=50)
    assert recall >= 0.95 and same == 1


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1), (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [], 1), (None, [1e-200, 0.0], 1), (13, [1e300, 0.0], 1), (14, [-1.0, 0.0], 1), (None, [1.0, 0.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").select("*", *[F.lit("clash").alias(c) for c in ("id", "v", "cls", "space", "path", "n", "links")])
    got = collections.Counter((r["id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect())
    group = [(1, 5, 1, True), (2, 5, 1, False), (3, 5, 1, False), (3, 5, 1, False), (None, 5, 1, False), (13, 5, 1, False)]
    alone = [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12, 14, None)]
    assert got == collections.Counter(group + alone)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_graph_reaches_all_and_is_pruned():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[:200] = x[0] + 0.05 * x[:200]  # a dense group
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    made = graph.FlatGraph.build(x)
    front, reached = [made.entry], {made.entry}
    while front:
        front = [int(b) for a in front for b in made.links[a] if b >= 0 and b not in reached and not reached.add(int(b))]
    assert len(reached) == 400
    near = x @ x.T >= 0.93
    sims = made.search(x, 32, 0.93)
    assert (sims >= 0.93).sum() >= 0.99 * near.sum() and (np.abs(sims - x @ x.T)[sims > -2] < 1e-4).all()
    one = graph.robust_prune(np.array([[1, 0], [0.99, 0.14], [0.98, 0.2], [-1, 0]], np.float32), np.array([[1, 2, 3]] * 4), 3, 1.2)
    assert one[0].tolist() == [1, 3, -1]  # 2 is nearer to 1 than to 0


# --- 13: resampling


def plain_resample(docs, target, n, buckets, least_words, share=(10, 100), seed=2024):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(text):
        w = word.findall((text or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    found = [(i, *features(t)) for i, t in docs]
    s, t = collections.Counter(b for *_, f in found for b in f), collections.Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    out = []
    for i, n_words, f in found:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n_words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((x for x in out if x[1] >= least_words), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    for k, x in enumerate(able[: share[0] * len(able) // share[1]], 1):
        x[5] = k
    return out


@pytest.mark.parametrize("n", [1, 2, 3])
def test_resampling_against_brute_force(spark, n):
    rng = random.Random(n)
    words = ["a", "B", "É", "x1", "42", "longer", "日本"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    docs += [(400, None), (401, ""), (402, "... !"), (None, "a b a b " * 10), (403, "word, " * 400_000), (404, "x" * 1_500_000), (404, "x" * 1_500_000)]
    target = ["a b a É", None, "x1 x1 42 " * 9]
    df = spark.createDataFrame(docs, "doc_id long, text string").select("*", *[F.lit("clash").alias(c) for c in ("id", "n_words", "features", "score", "rank")]).repartition(3)
    items = spark.createDataFrame([(t,) for t in target], "text string")
    got = [list(r) for r in resample.resample(df, items, buckets=100, most_words=n, least_words=5, share=(30, 100)).collect()]
    assert sorted(got, key=str) == sorted(plain_resample(docs, target, n, 100, 5, (30, 100)), key=str)
    assert resample.resample(df.limit(0), items).count() == 0
    assert {r["rank"] for r in resample.resample(df, items.limit(0), least_words=10**9).collect()} == {None}


def test_scores_that_tie_are_drawn_by_id(spark):
    scored = spark.createDataFrame([(i, 20, 7 if i % 3 else -300) for i in range(90)] + [(None, 20, 7)], "id long, n_words long, score long")
    got = {r["id"]: r["rank"] for r in resample.drawn(scored, (1, 2), 20).collect()}
    first = [i for i in range(90) if i % 3]
    assert [got[i] for i in first[:45]] == list(range(1, 46)) and {got[i] for i in [*first[45:], None, 0, 3]} == {None}


# --- hot keys and shapes in earlier operators


def test_ratings_that_meet_on_few_documents_leave_every_grade(spark):
    texts = {0: "bad awful poor", 1: "fair plain usual", 2: "good great fine"}
    rows = [(i, texts[0 if i < 40 else 2] + f" w{i % 7}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ratings = spark.createDataFrame([(i, 0) for i in range(40)] + [(100, 2)] * 30_000 + [(i, 2) for i in range(40, 60)], "doc_id long, grade int")
    fits = []
    for given in (ratings, ratings.orderBy(F.desc("doc_id")).repartition(5), ratings.repartition(1)):
        got, grades, weights = quality.sample(docs.repartition(3), given, 3, "doc_id", "text", "grade", 2000, 1 << 15)
        assert collections.Counter(grades.tolist()) == {0: 40, 2: 21}
        assert weights[grades == 0].sum() == pytest.approx(40) and weights[grades == 2].sum() == pytest.approx(30_020)
        model = quality.Cumulative.fit(quality.features(pa.array([t.decode() for t in got])), grades, 3, weights=weights)
        assert np.isfinite(model.thresholds).all() and (np.diff(model.thresholds) >= 0).all()  # grade 1 has no rating
        fits.append((got, model.thresholds.tolist(), model.weights.tolist()))
    assert fits[0] == fits[1] == fits[2]
    got, grades, weights = quality.sample(docs, ratings, 3, "doc_id", "text", "grade", 10, 1 << 15)
    assert collections.Counter(grades.tolist()) == {0: 10, 2: 10} and weights[grades == 2].sum() == pytest.approx(30_020)
    twice = docs.unionByName(docs.withColumn("text", F.lit("zzz")))
    assert len(quality.sample(twice, ratings, 3, "doc_id", "text", "grade", 2000, 1 << 15)[0]) == 61


def test_many_spans_in_one_text_take_time_as_the_text_does():
    text = " ".join(f"token={'A1b2' * 3}{i} {'Zq9' * 8}{i}" for i in range(100_000))
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        count_tokens = secrets.token_counter(f.read(), public_tokenizers.PATTERN)
    count_tokens("warm up")
    began = time.monotonic()
    base = secrets.base_spans(text)
    middle = time.monotonic()
    runs = secrets.candidate_runs(text)
    taken = [r for r in secrets.random_spans(text, base, lambda run: 1 << 30, runs=runs)]
    assert len(base) == 100_000 and len(taken) == 100_000 and time.monotonic() - began < 20, middle - began
    few = base[:400]
    part = text[: few[-1][1] + 40]
    plain = [(a, b) for a, b in secrets.candidate_runs(part) if all(b <= s or e <= a for s, e, _ in few) and b - a < 2.2 * count_tokens(part[a:b]) and not secrets.is_identifier(part[a:b], count_tokens)]
    assert [(a, b) for a, b, _ in secrets.random_spans(part, few, count_tokens)] == plain


def test_rules_of_many_shapes_keep_the_plan_small(spark):
    rng = random.Random(4)
    rules = [url_filter.Rule(".".join(f"h{rng.randint(0, 9)}" for _ in range(rng.randint(1, 4))), "/" + "p" * (i % 64), rng.choice(["allow", "block"])) for i in range(2000)]
    rules = list({(r.host, r.path): r for r in rules}.values())
    listed = {(r.host, r.path): r for r in rules}
    urls = [f"http://{'.'.join(f'h{rng.randint(0, 9)}' for _ in range(rng.randint(1, 5)))}/{'p' * rng.randint(0, 80)}" for _ in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame([(r.host, r.path, r.action) for r in rules], "host string, path string, action string")
    judged = url_filter.judge_urls(pages, table)
    assert len(judged._jdf.queryExecution().optimizedPlan().toString()) < 200_000
    got = {r["id"]: (r["rule"], r["verdict"]) for r in judged.collect()}
    for i, url in enumerate(urls):
        host, path = url[7:].split("/", 1)
        labels = host.split(".")
        fits = [listed[h, p] for k in range(len(labels)) if (h := ".".join(labels[k:])) for m in range(len(path) + 2) if (p := ("/" + path)[:m]) and (h, p) in listed]
        best = max(fits, key=lambda r: (len(r.host + r.path), len(r.host)), default=None)
        assert got[i] == (best and best.host + best.path, best.action if best else "allow"), url


def test_batches_of_the_operators_do_not_stay(spark, small):
    from docketspark.llm.queries import QUERIES
    from docketspark.plans import QUERIES as OTHERS

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    OTHERS["coverage_counts"](spark, small)
    before = spark.conf.get(key)
    QUERIES["op2_exact_dedup"](spark, small)
    assert spark.conf.get(key) == "256"
    OTHERS["coverage_counts"](spark, small)
    assert spark.conf.get(key) == before != "256"
    prepare(spark)
