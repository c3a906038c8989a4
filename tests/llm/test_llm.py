"""The training-data operators against brute force, round trips and held-out accuracy, and on edge cases.

Edge cases are nulls in every column, empty and very long texts, ties, repeated rows, empty tables, and extra columns whose
names clash with those the operators use themselves.
"""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from compare import duck_rows, spark_rows
from pyspark.sql import functions as F

import corpus_pipeline
from docketspark.llm import bpe, chat, common, decontaminate, exact_dedup, language_id, minhash, quality, secrets, token_counts, url_filter
from docketspark.llm.common import prepare
from docketspark.llm.queries import ORACLE_SQL, QUERIES
from docketspark.session import cut, ship

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CLASHING = ["row", "id", "node", "full", "lang_pred", "n_words", "hits", "key", "conv", "spans", "_0", "kept", "prefix"]


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    prepare(spark)
    ship(spark)


def docs_of(spark, *texts):
    """Documents with nulls in every column, a repeated row and extra columns of clashing names."""
    rows = [(i, t, "en" if i % 2 else "fr", "s", 1) for i, t in enumerate(texts)]
    rows += [(None, None, None, None, None), rows[0] if rows else (0, "x", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHING])


def empty_docs(spark):
    return docs_of(spark, "x").limit(0)


ODD = ["", " ", "\n\t ", "a", "É " * 3, "x" * 70_000, "word " * 30_000, "same text here", "same text here", "日本語 テキスト", "1 2 3", "<|endoftext|> İ ǅ.", "\x00\x1c\x85 a"]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_match_sql(spark, small, duck, name):
    assert spark_rows(QUERIES[name](spark, small)) == duck_rows(duck.sql(ORACLE_SQL[name]))


@pytest.fixture(scope="module")
def texts(duck):
    return {r[0]: (r[1], r[2]) for r in duck.sql("SELECT doc_id, text, lang FROM documents").fetchall()}


# --- 1: BPE


def library(text):
    from tokenizers import Tokenizer

    t = library.t = getattr(library, "t", None) or Tokenizer.from_file(TOKENIZER)
    ids = t.encode(text or "", add_special_tokens=False).ids
    return ids, t.decode(ids, skip_special_tokens=False)


def test_bpe_equals_the_library(spark, small, texts):
    got = {r["doc_id"]: r for r in QUERIES["op1_bpe"](spark, small).collect()}
    assert len(got) == len(texts)
    for i, (text, _) in texts.items():
        ids, decoded = library(text)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_bpe_edges(spark):
    rng = random.Random(4)
    pieces = [" ", "\n", "a", "the", "É", "é", "'s", "12", ".", "...", "<|endoftext|>", "<|", "İ", "ſ", "\x85", "日", "<|STARTOFTEXT|>", ","]
    mixed = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 4000))) for _ in range(20)]
    docs = docs_of(spark, *ODD, *mixed)
    for r in bpe.encode(docs, TOKENIZER, ("n_tokens", "ids", "decoded")).collect():
        ids, decoded = library(r["row"]["text"])
        assert (r["ids"], r["decoded"], r["n_tokens"]) == (ids, decoded, len(ids))
        assert r["row"]["key"] == "clash"
    assert bpe.encode(empty_docs(spark), TOKENIZER).count() == 0


def test_shared_chunks_are_encoded_once():
    passage = " ".join(f"shared{i} words" for i in range(2000))
    coder = bpe.Coder(open(TOKENIZER, encoding="utf-8").read())
    list(coder.slices(pa.array(["one " + passage])))
    first = coder.encoded
    list(coder.slices(pa.array(["quite another opening of the text " + passage])))
    assert coder.encoded - first <= 3 and coder.reused >= first - 3


@pytest.fixture(scope="module")
def tokenizer_text():
    return open(TOKENIZER, encoding="utf-8").read()


def test_chunks_of_the_corpus_are_reused(tokenizer_text, texts):
    """Copies and shared passages of the documents cost a look-up: chunks encoded are the distinct ones, no more."""
    coder = bpe.Coder(tokenizer_text)
    column = pa.array([t for t, _ in texts.values()], pa.string()).fill_null("")
    packed = [p for part in coder.slices(column) for p in part]
    assert [np.frombuffer(p, np.uint32).tolist() for p in packed] == [library(t)[0] for t, _ in texts.values()]
    assert coder.reused > 0.05 * (coder.encoded + coder.reused) and coder.grown == 0
    before = coder.encoded
    small = pa.array([t for t in column.to_pylist() if len(t) < 3000][:50])
    assert list(coder.slices(small)) == list(coder.slices(small)) and coder.encoded - before < 0.5 * sum(len(t) / bpe.LEAST_CHUNK + 1 for t in small.to_pylist())


def test_joins_grow_until_both_sides_agree(tokenizer_text, monkeypatch):
    coder = bpe.Coder(tokenizer_text)
    text = " ".join(f"word{i} and more," for i in range(2000))
    expected = np.array(library(text)[0], np.uint32).tobytes()
    assert [p for part in coder.slices(pa.array([text])) for p in part] == [expected] and coder.agreed and coder.grown == 0
    coder.agreed = dict.fromkeys(coder.agreed, False)  # as if no join agreed
    assert [p for part in coder.slices(pa.array([text])) for p in part] == [expected] and coder.grown == 1
    monkeypatch.setattr(bpe, "SLICE_BYTES", 1000)
    monkeypatch.setattr(bpe, "HASHED_IDS", 100)
    fresh = bpe.Coder(tokenizer_text)
    for t in (text, "x" * 5000, text + "y" * 3000 + " z", "\n" * 4000 + "end"):
        (got,) = [p for part in fresh.slices(pa.array([t])) for p in part]
        ids, decoded = library(t)
        assert np.frombuffer(got, np.uint32).tolist() == ids
        assert fresh.digests([got], fresh.decimal_table) == [hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()]
        assert fresh.digests([got], fresh.token_table) == [hashlib.sha256(decoded.encode()).hexdigest()]


# --- 2: exact dedup


def test_exact_dedup_edges(spark):
    docs = docs_of(spark, *ODD, "p" * 300 + "a", "p" * 300 + "b", "p" * 300 + "a")
    got = [tuple(r) for r in exact_dedup.exact_dedup(docs).select("id", "keep_id", "group_size", "kept").collect()]
    given = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    groups = collections.defaultdict(list)
    for i, t in given:
        groups[t].append(i)
    expected = []
    for i, t in given:
        keep = max((x for x in groups[t] if x is not None), default=None)
        expected.append((i, keep, len(groups[t]), i == keep))
    assert sorted(got, key=str) == sorted(expected, key=str)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert exact_dedup.exact_dedup(empty_docs(spark)).count() == 0 and exact_dedup.drop_copies(empty_docs(spark)).count() == 0


def test_exact_dedup_hashes_survivors_only(spark):
    docs = docs_of(spark, "alone", "twice", "twice", "p" * 300 + "a", "p" * 300 + "b").filter("doc_id is not null").dropDuplicates(["doc_id"])
    hashed = {r["id"]: r["full"] is not None for r in exact_dedup.exact_dedup(docs).collect()}
    assert hashed == {0: False, 1: True, 2: True, 3: True, 4: True}  # 3 and 4 agree in length and prefix
    assert all(r["full"] for r in exact_dedup.exact_dedup(docs, digest_all=True).collect())


def test_exact_dedup_decides_by_row(spark):
    rows = [(1, "a"), (1, "b"), (2, "a"), (None, "a"), (None, "c"), (None, "c"), (3, "d"), (3, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("clash").alias("row"), F.lit("clash").alias("full")).repartition(3)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted([(1, "b"), (2, "a"), (None, "c"), (3, "d")], key=str)


# --- 3: language ID


def test_language_accuracy_on_held_out(spark, small, texts):
    got = QUERIES["op3_language_id"](spark, small).collect()
    assert len(got) == len(texts)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["lang_pred"] == texts[r["doc_id"]][1] for r in held) / len(held) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_code_lengths_equal_a_plain_model(monkeypatch):
    sample = {"a": [b"abracadabra", b"abra ca"], "b": [b"banana band"]}
    tables = language_id.Tables(language_id.Statistics(sample))

    def plain(lang, text):
        counts = collections.defaultdict(collections.Counter)
        for t in sample[lang]:
            padded = b"\0\0\0" + t
            for k in range(3, len(padded)):
                for order in range(4):
                    context = padded[k - order : k]
                    if b"\0" not in context:
                        counts[context][padded[k]] += 1
        bits, padded = 0.0, b"\0\0\0" + text
        for k in range(3, len(padded)):
            for order in (3, 2, 1, 0):
                seen = counts.get(padded[k - order : k]) if b"\0" not in padded[k - order : k] else None
                if not seen:
                    continue
                total, distinct = sum(seen.values()), len(seen)
                if padded[k] in seen:
                    bits -= np.log2(seen[padded[k]] / (total + distinct))
                    break
                bits -= np.log2(distinct / (total + distinct))
            else:
                bits += 8
        return bits

    asked = [b"abra", b"band and z", b"a", b"\xff\xfe", b"", b"abracadabra banana " * 40]
    for block in (language_id.BLOCK, 7, 64):
        monkeypatch.setattr(language_id, "BLOCK", block)
        data = np.frombuffer(b"".join(t + b"\0\0\0" for t in asked), np.uint8)
        got = tables.lengths(data, np.cumsum([0, *(len(t) + 3 for t in asked)])) / language_id.BITS
        for text, bits in zip(asked, got, strict=True):
            assert bits == pytest.approx([plain("a", text), plain("b", text)], abs=0.05)


def test_trees_keep_every_context_of_many_languages():
    rng = random.Random(17)
    made = {f"l{k:03}": [bytes(rng.choices(range(1 + k, 250), k=2000)) for _ in range(2)] for k in range(100)}
    st = language_id.Statistics(made)
    tables = language_id.Tables(st)
    assert len(tables.levels[3].grams) == len({t[i : i + 4] for ts in made.values() for t in ts for i in range(len(t) - 3)})
    assert sum(c.nbytes for c in tables.cost) < 400e6
    own = [t for ts in made.values() for t in ts]
    data = np.frombuffer(b"".join(t + b"\0\0\0" for t in own), np.uint8)
    assert tables.lengths(data, np.cumsum([0, *(len(t) + 3 for t in own)])).argmin(1).tolist() == [k // 2 for k in range(200)]


def test_long_and_tied_texts_are_told(spark):
    long = "the quick brown fox " * 200_000
    docs = spark.createDataFrame([(0, long, "en"), (1, "le renard brun " * 50_000, "fr"), (2, "xyz", None)], "doc_id long, text string, lang string")
    model = language_id.fit(docs.withColumn("doc_id", F.col("doc_id") + 10), longest=1000)
    assert set(model.statistics.languages) <= {"en", "fr"} and model.statistics.languages
    twins = language_id.Statistics({"a": [b"same text"], "b": [b"same text"]})
    assert language_id.predict(twins, pa.array(["same", long[:3_000_000]]))[0].to_pylist() == ["a", "a"]


def test_language_edges(spark):
    docs = docs_of(spark, *ODD, "the cat and the dog", "le chat et le chien")
    model = language_id.fit(docs)
    got = {(r["row"]["doc_id"], r["row"]["text"]): r for r in language_id.identify(docs, model).collect()}
    assert got[None, None]["lang_pred"] == "und" and got[0, ""]["lang_pred"] == "und" and got[10, "1 2 3"]["lang_pred"] == "und"
    assert got[9, ODD[9]]["lang_pred"] in ("en", "fr") and got[9, ODD[9]]["row"]["lang_pred"] == "clash"
    none = language_id.fit(empty_docs(spark))
    assert {r["lang_pred"] for r in language_id.identify(docs, none).collect()} == {"und"}
    assert language_id.identify(empty_docs(spark), model).count() == 0


# --- 4: URL filter


def test_url_filter_against_brute_force(spark):
    rng = random.Random(2)
    labels, paths = ["a", "b", "net", "com", "x-y"], ["", "/", "/a", "/a/b", "/ab/", "/a/b/c"]
    rules = [url_filter.Rule(".".join(rng.choice(labels) for _ in range(rng.randint(1, 3))), rng.choice(paths[1:]), rng.choice(["allow", "block"])) for _ in range(25)]
    rules = list({(r.host, r.path): r for r in rules}.values())
    urls = [f"{rng.choice(['http', 'HTTPS'])}://{'.'.join(rng.choice(labels) for _ in range(rng.randint(1, 5)))}{rng.choice(paths)}{rng.choice(['', '?q=/a', '#/b', '/z'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "://", "http://", "http://A.NET/", "http://É.net/a"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").select("*", *[F.lit("clash").alias(c) for c in ("key", "keys", "host", "path", "rule")])
    got = {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rules).collect()}
    for i, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOWER)
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: (len(r.host + r.path), len(r.host)), default=None)
        assert got[i] == (host, path, best and best.host + best.path, best.action if best else "allow"), url
    as_table = spark.createDataFrame([(r.host.upper(), r.path, r.action) for r in rules] * 2 + [(None, None, "block")], "host string, path string, action string")
    assert {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, as_table.filter("host is not null")).collect()} == got
    both = [url_filter.Rule("net", "/", "block"), url_filter.Rule("NET", "/", "allow")]
    long = spark.createDataFrame([(1, "http://a.net/" + "x" * 200_000), (2, "http://" + "a." * 50_000 + "net/")], "page_id long, url string")
    assert {(r["rule"], r["verdict"]) for r in url_filter.judge_urls(long, both).collect()} == {("net/", "allow")}
    assert url_filter.judge_urls(pages, as_table.limit(0)).filter("verdict = 'allow'").count() == len(urls)
    assert url_filter.judge_urls(pages, []).filter("verdict = 'allow'").count() == len(urls)
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_cascade_is_exact_where_a_filter_alone_is_not(spark):
    listed = spark.range(0, 300).select(F.concat(F.lit("k"), "id").alias("key"))
    universe = spark.range(0, 5000).select(F.concat(F.lit("k"), "id").alias("key"))
    level = url_filter.Level.build(listed, 300, 0.3, 0)
    assert universe.filter(level.holds(F.col("key"))).count() > 400
    cascade = url_filter.Cascade.build(listed, universe, 300, 5000)
    assert len(cascade.levels) > 1
    assert {r[0] for r in universe.filter(cascade.lists(F.col("key"))).collect()} == {f"k{i}" for i in range(300)}


# --- 5: decontamination

WORD5 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_hits(text, items, window=13):
    words = WORD5.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for i, t in items:
        w = WORD5.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            part = w[k : k + window]
            for p in range(len(words) - len(part) + 1):
                if words[p : p + len(part)] == part:
                    hit |= set(range(p, p + len(part)))
                    found.add(str(i))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("most_items", [20_000, 2])
def test_decontamination_against_brute_force(spark, most_items):
    rng = random.Random(9)
    vocabulary = ["a", "of", "the", "É", "x9", "word", "longerword"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate((1, 2, 5, 13, 14, 30, 40))] + [(50, None), (51, "..."), (52, None)]
    items.append((60, items[4][1].upper()))
    made = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(25)]
    made += ["start " + items[5][1].replace(" ", " -- ") + " end", items[6][1] + " " + items[6][1], items[3][1], *ODD[:5], ODD[5]]
    docs = docs_of(spark, *made)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_passages(docs, benchmark, most_items=most_items).withColumn("n_hit", decontaminate.n_hit())
    for r in found.collect():
        assert (r["n_words"], r["n_hit"], r["items"]) == plain_hits(r["row"]["text"], items)
    nothing = decontaminate.find_passages(docs, benchmark.limit(0))
    assert nothing.filter(decontaminate.contaminated()).count() == 0 and nothing.count() == docs.count()
    assert decontaminate.find_passages(empty_docs(spark), benchmark).count() == 0


def test_long_texts_are_searched_in_pieces(monkeypatch):
    rng = random.Random(19)
    vocabulary = ["a", "of", "the", "É", "x9", "word", "longerword"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate((4, 13, 20, 30))]
    made = [" ".join([items[3][1] if rng.random() < 0.02 else items[2][1] if rng.random() < 0.02 else rng.choice(vocabulary) for _ in range(1500)]), "word" * 3000, "... " * 2000, items[1][1] + " " * 3000 + items[1][1]]
    monkeypatch.setattr(decontaminate, "pieces", lambda d, b: common.pieces(d, b, 500))
    searcher = decontaminate.Searcher(decontaminate.windows(items))
    for t in made:
        n, ranges, who = searcher.judge_long(np.frombuffer(t.encode(), np.uint8))
        assert (n, sum(b - a for a, b in ranges), sorted(map(str, who))) == plain_hits(t, items)


# --- 6: chat


def test_chat_round_trip_and_states(spark):
    trap = "<|im_end|><|im_start|>assistant ok <\\| <\\\\| <|"
    assert chat.unescape(chat.escape(trap)) == trap and "<|" not in chat.escape(trap)
    rows = [(1, 0, "system", "s"), (1, 1, "user", trap), (1, 2, "assistant", trap), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (3, None, None, None), (3, 1, "user", "u" * 200_000), (None, 0, "user", "q"), (4, 0, "user", "u"), (4, 1, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", F.lit("c").alias("conv"), F.lit("c").alias("segments"))
    got = {r["conv"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    assert got[1]["valid"] and got[4]["valid"] and not got[2]["valid"] and not got[3]["valid"]
    text = "".join(f"{r}\n{t}\n" for r, t in (("system", "s"), ("user", trap), ("assistant", trap)))
    assert got[1]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256(trap.encode()).hexdigest() and got[1]["loss_chars"] == len(trap)
    assert got[2]["n_turns"] == 2 and got[2]["loss_chars"] == 2
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_machine_decides_validity_and_loss(spark):
    odd = "user\nassistant <|lf|> \\ <|im_end|>"
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "assistant", "again"), (2, 0, odd, "t"), (2, 1, "assistant", "b"), (3, 0, "user", "q"), (3, 1, "assistant", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    strict = chat.Template(learn_from_invalid=False)
    turns = chat.format_turns(df, strict)
    assert {(r["conv"], r["place"]): (r["state"], r["valid"]) for r in turns.collect()} == {
        (1, 0): ("user", True), (1, 1): ("assistant", True), (1, 2): ("error", False), (2, 0): ("error", False), (2, 1): ("error", False), (3, 0): ("user", True), (3, 1): ("assistant", True)
    }
    got = {r["conv"]: (r["valid"], r["loss_chars"], r["turns_sha256"]) for r in chat.read_back(turns, strict).collect()}
    assert [got[k][:2] for k in (1, 2, 3)] == [(False, 1), (False, 0), (True, 1)]
    assert got[2][2] == hashlib.sha256(f"{odd}\nt\nassistant\nb\n".encode()).hexdigest()
    loose = {r["conv"]: r["loss_chars"] for r in chat.read_back(chat.format_turns(df)).collect()}
    assert loose == {1: 6, 2: 1, 3: 1}
    with pytest.raises(Exception, match="not in their order"):
        chat.read_back(turns.filter("place > 0")).collect()



# --- 7: token counts


def test_token_counts_equal_encoding(spark, small, texts):
    got = {r["doc_id"]: r["n_tokens"] for r in QUERIES["op7_token_counts"](spark, small).collect()}
    assert got == {i: len(library(t)[0]) for i, (t, _) in texts.items()}


def test_blocks_with_odd_bytes_and_long_documents(spark):
    data = np.array([5, 6, 99, 7] + [8] * 3000, "<u2").tobytes()
    rows = [("s", k // 100, data[k : k + 100]) for k in range(0, len(data), 100)]
    rows += [("s", len(rows), np.array([99], "<u2").tobytes() + b"x"), ("t", 0, None), ("t", 1, b"z")]
    blocks = spark.createDataFrame(rows, "stream string, block long, data binary").select("*", F.lit("clash").alias("ends"), F.lit(0).alias("n_tokens")).repartition(4)
    got = sorted((r["stream"], r["ordinal"], r["start"], r["n_tokens"], r["ended"]) for r in token_counts.count_tokens(blocks, 99).collect())
    assert got == [("s", 0, 0, 2, True), ("s", 1, 3, 3001, True)]


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_separator_scan_of_flat_files(spark, tmp_path, block):
    rng = random.Random(block)
    expected = []
    for name in ("a", "b", "c"):
        sizes = [rng.randint(0, 9) for _ in range(0 if name == "c" else 60)]
        tokens = [x for n in sizes for x in [rng.randint(0, 98) for _ in range(n)] + [99]]
        tail = rng.randint(0, 3) if name == "a" else 0
        (tmp_path / f"{name}.bin").write_bytes(np.array(tokens + [1] * tail, "<u2").tobytes())
        starts = np.cumsum([0, *(n + 1 for n in sizes)]).tolist()
        expected += [(name, k, starts[k], n, True) for k, n in enumerate(sizes)]
        expected += [(name, len(sizes), starts[-1], tail, False)] if tail else []
    blocks = token_counts.read_flat_files(spark, str(tmp_path), block_tokens=block, split_bytes=50)
    got = [(r["stream"].rsplit("/", 1)[1][0], r["ordinal"], r["start"], r["n_tokens"], r["ended"]) for r in token_counts.count_tokens(blocks, 99).collect()]
    assert sorted(got) == sorted(expected)


def test_packing_edges(spark):
    docs = docs_of(spark, *ODD, "a b c")
    blocks, order = token_counts.pack(docs, TOKENIZER, 49_408, block_tokens=2)
    found = token_counts.count_tokens(blocks, 49_408).join(order, ["stream", "ordinal"])
    assert sorted(((r["id"], r["n_tokens"]) for r in found.collect()), key=str) == sorted(((r["doc_id"], len(library(r["text"])[0])) for r in docs.collect()), key=str)
    none, _ = token_counts.pack(empty_docs(spark), TOKENIZER, 49_408)
    assert token_counts.count_tokens(none, 49_408).count() == 0
    with pytest.raises(ValueError):
        token_counts.pack(docs, TOKENIZER, 70_000)


# --- 8: near dedup

WORD8 = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD8.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def plain_components(rows):
    """Exact: every pair of different sets is compared."""
    sets = collections.defaultdict(list)
    for i, t in rows:
        sets[shingles(t)].append(i)
    keys = [s for s in sets if s]
    parent = list(range(len(keys)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(keys)):
        for b in range(a):
            x, y = keys[a], keys[b]
            if 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) and 100 * (n := len(x & y)) >= 75 * (len(x) + len(y) - n):
                parent[find(a)] = find(b)
    least = {}
    for a, s in enumerate(keys):
        ids = [i for i in sets[s] if i is not None]
        least[find(a)] = min([*ids, *([least[find(a)]] if find(a) in least else [])])
    at = {s: a for a, s in enumerate(keys)}
    return {i: (len(shingles(t)), least[find(at[shingles(t)])] if shingles(t) else i) for i, t in rows}


def edited(words, rate, rng):
    return [f"new{rng.randint(0, 10**9)}" if rng.random() < rate else w for w in words]


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(6)
    base = [[f"w{rng.randint(0, 5000)}" for _ in range(150)] for _ in range(4)]
    made = [" ".join(edited(rng.choice(base), rng.choice([0, 0.01, 0.03, 0.06, 0.1]), rng)) for _ in range(260)]
    made += [" ".join(edited([f"z{i}"] * 3, 0, rng)) for i in range(5)] + ["A b c d e f", "a B c d e f", "", " ", None, "one", "ONE", "x " * 50]
    rows = list(enumerate(made, 100))
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("clash").alias(c) for c in CLASHING]).repartition(5)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df).collect()}
    assert got == plain_components(rows)


def test_near_duplicates_in_crowded_buckets(spark):
    """Sets that share a passage and little else crowd its buckets; those over the limit are dealt by their rarest shingles."""
    rng = random.Random(16)
    passage = [f"p{i}" for i in range(60)]
    made = [" ".join(passage + [f"w{rng.randint(0, 10**9)}" for _ in range(40)]) for _ in range(60)]
    made += [" ".join(edited(t.split(), 0.02, rng)) for t in made[:30] for _ in range(2)]
    rows = list(enumerate(made, 100))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = plain_components(rows)
    assert len({c for _, c in expected.values()}) > 40
    for hot in (20, minhash.HOT):
        assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, hot=hot).collect()} == expected


def test_recall_on_documents(spark, texts):
    """Every link between documents is found, copies and near copies alike, and no other."""
    rows = [(i, t) for i, (t, _) in texts.items()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op8_minhash_dedup"](spark, SMALL).collect()}
    assert got == plain_components(rows)


def test_long_texts_are_read_in_pieces(monkeypatch):
    rng = random.Random(21)
    made = [" ".join(f"w{rng.randint(0, 900)}" for _ in range(3000)), "x" * 9000, "a " * 4000, "\n ".join(["b" * 3000, "C", "d", "e f", "g" * 5000, "h"]), "one two three", " " * 5000, "é" * 3000 + " ü"]
    whole = [s.tolist() for s in minhash.shingle_sets(pa.array(made))]
    monkeypatch.setattr(minhash, "slices", lambda t: [(i, i + 1) for i in range(len(t))])
    monkeypatch.setattr(minhash, "long_text", lambda t, i, j: common.long_text(t, i, j, 100))
    monkeypatch.setattr(minhash, "pieces", lambda d, b: common.pieces(d, b, 1000))
    monkeypatch.setattr(common, "POWER_BLOCK", 512)
    assert [s.tolist() for s in minhash.shingle_sets(pa.array(made))] == whole
    assert [len(s) for s in whole] == [len(shingles(t)) for t in made]


def test_near_duplicates_edges(spark):
    docs = docs_of(spark, *ODD)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(ODD) + 2
    by = {r["id"]: r for r in got}
    assert by[8]["component_id"] == 7 and not by[8]["kept"] and by[0]["n_shingles"] == 0 and by[None]["component_id"] is None
    assert minhash.near_duplicates(empty_docs(spark)).count() == 0


def test_circulant_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = pool[:2000], pool[500:2500]
    assert abs((minhash.signature(a) == minhash.signature(b)).mean() - 1500 / 2500) < 0.08
    assert np.array_equal(minhash.pi_slices()[5][1:], minhash.pi_slices()[6][:-1])


def test_components_over_chains(spark):
    nodes = cut(spark.range(200).select(F.col("id").alias("node"), F.col("id").alias("comp")))
    links = spark.range(0, 99).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r["node"]: r["comp"] for r in minhash.components(nodes, links).collect()}
    assert got == {i: 0 if i < 100 else i for i in range(200)}


def test_components_over_long_chains_of_any_labels(spark):
    rng = random.Random(3)
    names = [rng.randint(-(2**63), 2**63 - 1) for _ in range(2300)]
    pairs = [(names[i], names[i + k]) for i in range(1998) for k in (1, 2)]  # a chain, each linked to the next two
    pairs += [(names[2000], names[i]) for i in range(2001, 2100)] + [(names[2100 + i], names[2101 + i]) for i in range(99)] + [(names[2100], names[2199])]  # a star, a circle
    rng.shuffle(pairs)
    nodes = cut(spark.createDataFrame([(n, n) for n in names], "node long, comp long"))
    got = {r["node"]: r["comp"] for r in minhash.components(nodes, spark.createDataFrame(pairs, "a long, b long")).collect()}
    expected = {n: min(part) for part in (names[:2000], names[2000:2100], names[2100:2200]) for n in part}
    assert got == {n: expected.get(n, n) for n in names}


# --- 9: secrets


def plain_base(text):
    out = [(m.start(), m.end(), "assign") for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[0], ["assign", "access", "hex"].index(s[2])))


SECRETS = ["", "secret: token: abcdefgh", "PassWord = 'hunter22' é", "apikey=abc api_key:\"abcdefg\"", "AKIA" + "A" * 16 + " AKIAIOSF", "0" * 23 + " " + "f" * 24, "ſecret=abcdefg toKen=abcdefg", "token==abcdef", "日本 token = zzzzzz " + "ab12" * 10]


def test_secret_patterns_against_brute_force(spark, small, texts):
    for text in [*SECRETS, *(t for t, _ in texts.values())]:
        assert secrets.base_spans(text) == plain_base(text), text[:80]
    got = {r["doc_id"]: r for r in QUERIES["op9_secret_scan"](spark, small).collect()}
    assert len(got) == len(texts)
    for i, (text, _) in texts.items():
        base = plain_base(text)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
        assert got[i]["n_assign"] == sum(k == "assign" for *_, k in base)


def test_secret_scan_edges(spark, count_tokens):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        vocabulary = f.read()
    docs = docs_of(spark, *ODD, *SECRETS, "Q7" * 40_000, "word " * 200_000 + "token=abcdefgh")
    got = collections.Counter((r["id"], tuple((s["start"], s["end"], s["kind"]) for s in r["spans"] if s["kind"] != "random")) for r in secrets.scan_secrets(docs, vocabulary, public_tokenizers.PATTERN).collect())
    assert got == collections.Counter((r["doc_id"], tuple(plain_base(r["text"] or ""))) for r in docs.collect())


def test_token_efficiency_finds_random_strings_only(spark):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        vocabulary = f.read()
    rng = random.Random(8)
    random_text = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(44))
    clean = ["international_monetary_fund_2024", "123e4567-e89b-12d3-a456-426614174000", "ThisIsACamelCaseIdentifier42", "D41D8CD98F00B204E9800998ECF8427E", "a very ordinary sentence without anything in it", None]
    docs = docs_of(spark, f"key {random_text} end", *clean)
    got = {r["id"]: [(s["start"], s["end"], s["kind"]) for s in r["spans"]] for r in secrets.scan_secrets(docs, vocabulary, public_tokenizers.PATTERN).collect()}
    assert got[0] == [(4, 48, "random")] and not any(got[i] for i in range(1, len(clean) + 1)) and got[None] == []
    assert secrets.scan_secrets(empty_docs(spark), vocabulary, public_tokenizers.PATTERN).count() == 0


@pytest.fixture(scope="module")
def count_tokens():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return secrets.token_counter(f.read(), public_tokenizers.PATTERN)


UPPER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


@pytest.mark.parametrize("signs", [UPPER + "234567", UPPER.lower() + DIGITS, UPPER + DIGITS, UPPER.lower(), UPPER, UPPER + UPPER.lower(), UPPER + UPPER.lower() + DIGITS + "-_"], ids=["base32", "base36", "BASE36", "lower", "upper", "letters", "base64url"])
@pytest.mark.parametrize("length", [20, 32, 64])
def test_random_strings_of_every_alphabet_are_found(count_tokens, signs, length):
    rng = random.Random(length)
    made = ["".join(rng.choice(signs) for _ in range(length)) for _ in range(1000)]
    found = [s for s in made if secrets.random_spans(f"key {s} end", [], count_tokens) == [(4, 4 + length, "random")]]
    assert len(found) >= 0.98 * len(made)


def test_words_and_identifiers_are_not_random(count_tokens):
    for run in ("src/main/java/com/foo/bar_baz", "en/us/de/fr/it/es/nl/pl", "max_doc_len_2024_05_17_v", "anticonstitutionnellement", "Donaudampfschifffahrtsgesellschaft", "x" * 70_000, "12345678901234567890", "-" * 30):
        assert secrets.random_spans(run, [], count_tokens) == [], run[:60]


def test_long_runs_take_linear_time(count_tokens):
    import time

    began = time.monotonic()
    secrets.random_spans("Ab" * 50_000 + "B1 " + "a" * 60_000 + "B1", [], count_tokens)
    assert time.monotonic() - began < 10


# --- 10: quality


def test_quality_tells_held_out_ratings_apart(spark, duck, small):
    """On ratings the fit has not seen: the best grade's documents are kept, most others are not, and grades are ordered."""
    where = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in QUERIES["op10_quality"](spark, where).collect()}
    rated = duck.sql(f"SELECT doc_id, quality, toxic FROM '{where}/labels.parquet'").fetchall()
    held = [(got[i], q + 1 - t) for i, q, t in rated if got[i]["held_out"]]
    assert len(held) > 100
    best, rest = ([r for r, g in held if (g == 2) == top] for top in (True, False))
    assert sum(r["kept"] for r in best) >= 0.95 * len(best)
    assert sum(not r["kept"] for r in rest) >= 0.85 * len(rest)
    pairs = [(a["expected_grade"], b["expected_grade"]) for a, x in held for b, y in held if x > y]
    assert sum(a > b for a, b in pairs) >= 0.9 * len(pairs)
    assert all(0 <= r["expected_grade"] <= 2 for r in got.values())


def test_fit_equals_a_plain_optimiser():
    rng = random.Random(23)
    grades = np.array([rng.choice([0, 1, 1, 2]) for _ in range(160)])
    rows = [np.array(sorted({rng.randint(0, 5) + 4 * int(g) for _ in range(4)})) for g in grades]
    weights = np.array([rng.choice([1.0, 3.0]) for _ in rows])
    penalty = 0.003
    model = quality.Cumulative.fit(rows, grades, 3, penalty, steps=4000, weights=weights)
    known = sorted({int(c) for r in rows for c in r if sum(int(c) in x for x in rows) >= quality.LEAST_DOCS})
    odds = {}
    for c in known:
        has = np.array([c in r for r in rows])
        lesser = [min((grades > k).sum(), (grades <= k).sum()) for k in (0, 1)]
        ratios = [abs(np.log((has[grades > k].sum() + 1) / ((grades > k).sum() + 2) / (has[grades <= k].sum() + 1) * ((grades <= k).sum() + 2))) for k in (0, 1)]
        odds[c] = np.dot(lesser, ratios) / sum(lesser)
    x = np.array([[(c in r) * odds[c] for c in known] for r in rows])
    x /= np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-9)
    each = weights * len(rows) / weights.sum()

    def loss(v):
        tails = 1 / (1 + np.exp(-((x @ v[:-2])[:, None] - v[-2:])))
        above = grades[:, None] > np.arange(2)
        return -(each[:, None] * np.where(above, np.log(tails), np.log(1 - tails))).sum() / len(rows) + 10 * penalty / len(rows) / 2 * (v[:-2] ** 2).sum()

    v, step = np.zeros(len(known) + 2), 1.0
    for _ in range(6000):  # steepest descent by differences, with a step that adapts
        slope = np.array([(loss(v + 1e-5 * e) - loss(v - 1e-5 * e)) / 2e-5 for e in np.eye(len(v))])
        if np.abs(slope).max() < 1e-5:
            break
        while loss(v - step * slope) > loss(v) - 0.3 * step * (slope**2).sum():
            step /= 2
        v, step = v - step * slope, step * 1.5
    fitted = np.concatenate([model.weights[known], model.thresholds])
    assert loss(fitted) <= loss(v) + 1e-4 and np.abs(fitted - v).max() < 0.2


def test_long_texts_have_the_same_features(monkeypatch):
    made = ["word word, and so on. " * 300, "x" * 4000, " ".join(["again"] * 900), "a b  c\n" * 500 + "!" * 700, ""]
    whole = [f.tolist() for f in quality.features(pa.array(made))]
    monkeypatch.setattr(quality, "pieces", lambda d, b: common.pieces(d, b, 300))
    assert [quality._long_features(np.frombuffer(t.encode(), np.uint8)).tolist() for t in made] == whole


def test_cumulative_link_orders_grades():
    rng = random.Random(1)
    words = {0: ["bad", "awful"], 1: ["fair", "plain"], 2: ["good", "great"]}
    grades = np.array([k % 3 for k in range(300)])
    made = pa.array([" ".join(rng.choice(words[int(g)]) for _ in range(6)) + f" noise{rng.randint(0, 20)}" for g in grades])
    model = quality.Cumulative.fit(quality.features(made), grades, 3)
    tails = model.tails(quality.features(made))
    assert (np.diff(model.thresholds) >= 0).all() and (tails[:, 0] >= tails[:, 1]).all()
    assert ((tails > 0.5).sum(1) == grades).mean() > 0.97


def test_quality_edges(spark):
    docs = docs_of(spark, *ODD)
    ratings = docs.select("doc_id", (F.col("doc_id") % 3).cast("int").alias("grade"))
    model = quality.fit(docs, ratings, 3)
    assert quality.rate(docs, model, 2).filter("tail is null").count() == 0
    none = quality.fit(docs, ratings.limit(0), 3)
    assert quality.rate(docs, none, 2).filter("tail is not null").count() == 0
    assert quality.rate(empty_docs(spark), model, 2).count() == 0
    same = {r["tail"] for r in quality.rate(docs, model, 2).collect() if r["row"]["text"] == "same text here"}
    assert len(same) == 1
    off = quality.fit(docs, ratings.withColumn("grade", F.col("grade") + 7), 3)
    assert quality.rate(docs, off, 2).filter("tail is not null").count() == 0
    with pytest.raises(ValueError):
        quality.fit(docs, ratings, 1)


@pytest.mark.parametrize("docs_per_grade", [2000, 60])
def test_quality_prior_does_not_depend_on_the_samples_limit(spark, docs_per_grade):
    rng = random.Random(5)
    grades = [2] * 450 + [1] * 130 + [0] * 20
    rows = [(i, " ".join(f"w{rng.randint(0, 30)}" for _ in range(8)), g) for i, g in enumerate(grades)]
    docs = spark.createDataFrame([*rows, (1000, "", None)], "doc_id long, text string, grade int")
    model = quality.fit(docs.filter("text != ''"), docs.select("doc_id", "grade"), 3, docs_per_grade=docs_per_grade)
    empty = quality.rate(docs.filter("doc_id = 1000"), model, 2).first()
    assert empty["tail"] == pytest.approx(450 / 600, abs=0.08)
    assert empty["expected_grade"] == pytest.approx((2 * 450 + 130) / 600, abs=0.15)


# --- pipeline


def test_pipeline_against_brute_force(spark, small, duck):
    rows = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    items = duck.sql("SELECT item_id, text FROM benchmark").fetchall()
    rows = [(i, t) for i, t in rows if any(map(str.isalpha, t or ""))]
    keep = {}
    for i, t in rows:
        keep[t] = max(i, keep.get(t, i))
    rows = [(i, t) for i, t in rows if keep[t] == i]
    component = plain_components(rows)
    rows = [(i, t) for i, t in rows if component[i][1] == i]
    windows = decontaminate.windows(items)
    rows = [(i, t) for i, t in rows if not _contaminated(t, windows)]
    got = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, small).collect()}
    assert got == {i: len(library(t)[0]) for i, t in rows}


def _contaminated(text, windows):
    words = WORD5.findall((text or "").translate(LOWER))
    hit = set()
    for k in range(len(words) - 12):
        if f" {' '.join(words[k : k + 13])} ".encode() in windows:
            hit |= set(range(k, k + 13))
    return bool(hit) and 20 * len(hit) >= len(words)


def test_stages_keep_columns_and_edges(spark, small):
    docs = cut(docs_of(spark, *ODD, "the same words again and again in one text", "the same words again and again in one text"))
    expected = {"language_id": len(ODD) + 4 - 6, "exact_dedup": len(ODD) + 4 - 4, "near_dedup": len(ODD) + 4 - 2, "decontaminate": len(ODD) + 4}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, small)
        assert stage(spark, docs.limit(0), small).count() == 0
        if name == "bpe":
            assert sorted(((r["doc_id"], r["n_tokens"]) for r in after.collect()), key=str) == sorted(((r["doc_id"], len(library(r["text"])[0])) for r in docs.collect()), key=str)
        else:
            assert after.columns == docs.columns and after.count() == expected[name], name


def test_near_dedup_decides_by_row(spark):
    rng = random.Random(12)
    base = [[f"w{rng.randint(0, 9000)}" for _ in range(200)] for _ in range(6)]

    def near(k, word):
        return " ".join([*base[k][:-1], word])

    rows = [
        *((1, near(0, "a")), (None, near(0, "b")), (None, near(1, "a"))),  # a copy without id; a clean text without id
        *((2, near(2, "a")), (3, near(2, "b")), (3, near(3, "a"))),  # an id with a copy's and with a clean text
        *((4, near(4, "a")), (4, near(4, "b")), (4, near(4, "B"))),  # copies that share an id, two of equal sets
        *((None, near(5, "a")), (None, near(5, "b")), (None, near(5, "b"))),  # copies without ids
        *((5, "one row twice"), (5, "one row twice"), (None, ""), (None, ""), (6, None), (6, None)),  # without words: linked with nothing
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("clash").alias("own"), F.lit("clash").alias("digest")).repartition(3)
    left = corpus_pipeline.near_dedup(spark, docs, "")
    assert left.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in left.collect()]
    expected = [(1, near(0, "a")), (2, near(2, "a")), (3, near(3, "a")), (5, "one row twice"), (6, None), (6, None)]
    assert sorted((r for r in got if r[0] in (1, 2, 3, 5, 6)), key=str) == sorted(expected, key=str)
    assert sum(r[0] == 4 for r in got) == 1
    assert sorted(t for i, t in got if i is None and t not in (near(5, "a"), near(5, "b"))) == sorted(["", "", near(1, "a")])
    assert sum(t in (near(5, "a"), near(5, "b")) for _, t in got) == 1
