"""URL filter: rules of (host, path, action) held in a Bloom filter cascade and matched without a join.

A rule fits its host and all subdomains if the url's path starts with the rule's path. A url's candidate keys are its
host suffixes, as many labels as a rule has, with its path's prefixes of the rules' path lengths; the longest listed key
wins, then the longer host. Level 0 of the cascade encodes the listed keys. Every key of the corpus that level 0 takes
for listed though it is not goes into level 1, and so on in turn, until a level has no false positive: over this complete
key universe membership is then exact. Level 0 is sized by the rules and the number of urls so that about as many false
positives as rules are expected, so all levels stay in proportion to the rule list.

Rules are a list in a program or a table (host, path, action). What grows with the rules is the filter, some 35 bits a rule,
which every executor holds (a million rules: 4 MB); what is written into the plan is the rules' shape alone: the most labels of
a host and the paths' lengths.

Defined cases: null url, or one without ``://``: host and path are empty and no rule fits; urls of any length are judged, by
as many candidate keys as the rules' shape has; rules' hosts are lower-cased (A-Z), null hosts or paths are empty; a rule with
both actions allows; of two rules of one length that with the longer host wins; repeated urls are judged each; an empty rule
list gives the default verdict; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketspark.session import cut

MOST_LEVELS = 60


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    action: str


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``words`` is a one-row DataFrame with ``bits array<long>``."""

    words: DataFrame
    n_bits: int
    n_hashes: int
    seed: int

    def holds(self, key: Column) -> Column:
        bits = self.words.scalar()
        hit = F.lit(True)
        for at in self._positions(key):
            word = F.get(bits, F.shiftrightunsigned(at, 6).cast("int"))
            hit = hit & (F.call_function("shiftrightunsigned", word, at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return hit

    def _positions(self, key: Column) -> list[Column]:
        first, second = F.xxhash64(F.lit(2 * self.seed), key), F.xxhash64(F.lit(2 * self.seed + 1), key)
        return [F.pmod(first.bitwiseXOR(F.shiftleft(second, i)), F.lit(self.n_bits)).cast("long") for i in range(self.n_hashes)]

    @classmethod
    def build(cls, keys: DataFrame, n_keys: int, fpp: float, seed: int) -> Level:
        n_bits = max(64, math.ceil(-n_keys * math.log(fpp) / math.log(2) ** 2 / 64) * 64)
        empty = cls(keys, n_bits, max(1, min(24, round(-math.log2(fpp)))), seed)
        at = keys.select(F.explode(F.array(*empty._positions(F.col("key")))).alias("at"))
        value = F.call_function("shiftleft", F.expr("1L"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))
        words = (
            at.select(F.shiftrightunsigned("at", 6).alias("word"), value.alias("value"))
            .unionByName(keys.sparkSession.range(n_bits // 64).select(F.col("id").alias("word"), F.expr("0L").alias("value")))
            .groupBy("word")
            .agg(F.bit_or("value").alias("value"))
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "value"))), lambda x: x["value"]).alias("bits"))
        )
        return cls(cut(words, f"cascade-level-{seed}"), n_bits, empty.n_hashes, seed)


@dataclass(frozen=True)
class Cascade:
    levels: list[Level]

    def lists(self, key: Column) -> Column:
        """Exact for every key of the universe it was built over: the first level that misses the key decides."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            answer = F.when(~self.levels[i].holds(key), F.lit(i % 2 == 1)).otherwise(answer)
        return answer if self.levels else F.lit(False)

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, n_listed: int, n_universe: int, first_seed: int = 0) -> Cascade:
        """``listed``: distinct keys; ``universe``: keys with repeats, in which every listed key counts as listed."""
        if not n_listed:
            return cls([])
        fpp = min(0.5, max(2.0**-24, n_listed * math.sqrt(0.5) / max(1, n_universe)))
        levels = [Level.build(listed, n_listed, fpp, first_seed)]
        inside, outside = listed, None
        while len(levels) < MOST_LEVELS:
            if outside is None:  # the one scan of the corpus' keys; what the level rejects is not shuffled
                outside = universe.filter(levels[0].holds(F.col("key"))).distinct().join(listed, "key", "left_anti")
                wrong = outside
            else:
                wrong = inside.filter(levels[-1].holds(F.col("key")))
            wrong = cut(wrong.select("key"), "cascade-wrong")
            n_wrong = wrong.count()
            if not n_wrong:
                return cls(levels)
            levels.append(Level.build(wrong, n_wrong, 0.5, first_seed + len(levels)))
            # what the new level must not hold, of the keys that came through all levels before it
            inside = (listed if len(levels) == 2 else previous)
            previous = wrong
        raise ValueError(f"the cascade did not close after {MOST_LEVELS} levels")


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """A program's own list of rules as a table (host, path, action)."""
    rows = F.array(*[F.struct(F.lit(r.host).alias("host"), F.lit(r.path).alias("path"), F.lit(r.action).alias("action")) for r in dict.fromkeys(rules)])
    return spark.range(1, numPartitions=1).select(F.inline(rows))


def keyed(rules: DataFrame) -> DataFrame:
    """Distinct rules: key, labels (of the host), length (of the path), action."""
    host = F.translate(F.coalesce("host", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.coalesce("path", F.lit(""))
    shaped = rules.select(F.concat(host, F.lit("\x00"), path).alias("key"), F.size(F.split(host, r"\.")).alias("labels"), F.length(path).alias("length"), "action")
    return shaped.groupBy("key", "labels", "length").agg(F.min("action").alias("action"))  # allow is the lesser word


def candidates(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """Keys a rule could have that fits, the longest first and of equal length that with the longer host."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    hosts = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(labels))), lambda k: F.array_join(F.slice(parts, n - k + 1, k), "."))
    fitting = F.filter(F.lit(lengths), lambda m: m <= F.length(path))
    paths = F.transform(fitting, lambda m: F.substring(path, F.lit(1), m))
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.struct((-F.length(h) - F.length(p)).alias("long"), (-F.length(h)).alias("host"), F.concat(h, F.lit("\x00"), p).alias("key")))))
    return F.transform(F.array_sort(pairs), lambda x: x["key"])


def judge_urls(pages: DataFrame, rules: list[Rule] | DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: id, host, path, rule (host and path of the one that decides, or null), verdict.

    Candidate keys are rows, beside one row of the page itself, so the plan holds each cascade once, whatever the rules' shape.
    Keys that are not listed go no further; what is shuffled is a page's narrow row and the keys that its rules have.
    """
    rows = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if isinstance(rules, list):
        rules = rule_table(pages.sparkSession, rules) if rules else None
    listed = cut(keyed(rules), "rules") if rules is not None else None
    shape = listed.agg(F.count("*").alias("n"), F.count_if(F.col("action") == "allow").alias("n_allow"), F.max("labels").alias("labels"), F.sort_array(F.collect_set("length")).alias("lengths")).first() if listed is not None else None
    if shape is None or not shape["n"]:
        return rows.select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    rows = cut(rows.withColumn("page", F.monotonically_increasing_id()), "urls")  # a number of its own, once written
    keys_of = candidates(F.col("host"), F.col("path"), shape["labels"], shape["lengths"])
    asked = rows.select("page", F.posexplode(keys_of).alias("place", "key"))
    keys = listed.select("key")
    cascade = Cascade.build(keys, asked.select("key"), shape["n"], rows.count() * shape["labels"] * len(shape["lengths"]))
    # the rules' actions are a second, small membership question: which listed keys allow?
    allows = Cascade.build(listed.filter(F.col("action") == "allow").select("key"), keys, shape["n_allow"], shape["n"], first_seed=1000)
    found = asked.filter(cascade.lists(F.col("key"))).select("page", F.struct("place", "key").alias("hit"))
    whole = rows.select("page", F.lit(None).cast(found.schema["hit"].dataType).alias("hit"), F.struct("id", "host", "path").alias("row"))
    together = whole.unionByName(found.withColumn("row", F.lit(None).cast(whole.schema["row"].dataType)))
    # the first of a page's listed keys decides; min and max pass over null
    judged = together.groupBy("page").agg(F.min("hit").alias("hit"), F.max("row").alias("row")).select("row.*", F.col("hit.key").alias("key"))
    verdict = F.when(F.col("key").isNull(), F.lit(default)).when(allows.lists(F.col("key")), "allow").otherwise("block")
    return judged.select("id", "host", "path", F.translate("key", "\x00", "").alias("rule"), verdict.alias("verdict"))
