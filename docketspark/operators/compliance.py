"""Rules to numbers to verdicts: compliance checks, permit checklists, comparisons between municipalities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketspark.functions.limits import extract_limit
from docketspark.operators.postings import TermIndex
from docketspark.operators.retrieval import tokens
from docketspark.session import cut

_AREA, _LENGTH, _NONE = ("m2", "ft2"), ("m", "ft"), ()
_FASCIA = ("fascia sign", "wall sign", "maximum sign area")
# fixed values: where each rule is looked for: sign type, dimension, terms, units, ratio of the frontage
RULE_LOCATIONS = (
    ("fascia", "area", (*_FASCIA, "sign area per metre of frontage"), _AREA, True),
    ("fascia", "height", ("fascia sign height", "wall sign maximum height", "projection above roof"), _LENGTH, False),
    ("fascia", "illumination", ("illuminated fascia sign", "illumination", "internally illuminated"), _NONE, False),
    ("fascia", "permit", ("sign permit required", "permit"), _NONE, False),
    ("channel_letter", "area", ("channel letter", "individual letters", *_FASCIA), _AREA, True),
    ("channel_letter", "illumination", ("channel letter illumination", "internally illuminated", "halo lit"), _NONE, False),
    ("channel_letter", "permit", ("sign permit required", "permit"), _NONE, False),
    ("pylon", "area", ("pylon sign", "freestanding sign area", "maximum sign area"), _AREA, False),
    ("pylon", "height", ("pylon sign height", "maximum height", "freestanding sign height"), _LENGTH, False),
    ("pylon", "setback", ("setback", "property line", "minimum distance from"), _LENGTH, False),
    ("pylon", "permit", ("sign permit required", "permit"), _NONE, False),
    ("freestanding", "area", ("freestanding sign", "ground sign", "maximum sign area"), _AREA, False),
    ("freestanding", "height", ("freestanding sign height", "ground sign height", "maximum height"), _LENGTH, False),
    ("freestanding", "setback", ("setback", "property line", "sight triangle"), _LENGTH, False),
    ("freestanding", "permit", ("sign permit required", "permit"), _NONE, False),
    ("window", "area", ("window sign", "percentage of window area", "window coverage"), ("%", "m2", "ft2"), False),
    ("window", "permit", ("window sign permit", "exempt"), _NONE, False),
    ("digital", "area", ("digital sign", "electronic message", "changeable copy"), _AREA, False),
    ("digital", "illumination", ("brightness", "nits", "luminance", "dwell time", "message duration"), _NONE, False),
    ("digital", "permit", ("digital sign permit", "permit"), _NONE, False),
    ("awning", "area", ("awning sign", "canopy sign", "maximum sign area"), _AREA, False),
    ("projecting", "area", ("projecting sign", "blade sign", "maximum sign area"), _AREA, False),
    ("projecting", "setback", ("projection over", "encroachment", "clearance above"), _LENGTH, False),
    ("canopy", "area", ("canopy sign", "marquee sign", "maximum sign area"), _AREA, False),
)
NUMERIC = ("area", "height", "setback")
# fixed values: topics of a permit checklist and their terms
TOPICS = (
    ("application", ("sign permit application", "application shall include")),
    ("drawings", ("drawings", "scaled drawing", "elevation", "dimensions")),
    ("site_plan", ("site plan", "location of the sign", "plot plan")),
    ("electrical", ("electrical permit", "electrical connection", "wiring")),
    ("structural", ("structural", "professional engineer", "sealed drawings", "wind load")),
    ("fees", ("permit fee", "fees payable", "fee schedule")),
    ("exemptions", ("exempt", "no permit required", "permit is not required")),
    ("heritage", ("heritage", "design review", "development permit area")),
)
SEVERITY = {"exceeds": 2, "indeterminate": 1, "complies": 0}


def rule_locations(spark) -> DataFrame:
    schema = "sign_type string, dimension string, terms array<string>, units array<string>, is_ratio boolean"
    return spark.createDataFrame([(a, b, list(c), list(d), e) for a, b, c, d, e in RULE_LOCATIONS], schema)


def _citable(chunks: DataFrame) -> DataFrame:
    return chunks.filter((F.col("document_status") == "in_force") & ~F.coalesce(F.col("from_ocr"), F.lit(False)))


def governing_limits(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """For each (slug, sign_type, dimension, terms, units) asked: the limit of the first chunk, by hits and id, that states one.

    ``chunks``: chunk_id, municipality_slug, document_status, from_ocr, body. Chunks are joined by city, and only those with a
    term of the rule remain.
    """
    rows = asked.join(_citable(chunks), "municipality_slug")
    hits = F.size(F.filter("terms", lambda t: F.contains(F.lower(F.col("body")), t)))
    stated = rows.withColumn("hits", hits).filter("hits > 0").withColumn("limit", extract_limit(F.col("body"), F.col("units"))).filter("limit is not null")
    key = ["municipality_slug", "sign_type", "dimension"]
    order = F.struct((-F.col("hits")).alias("hits"), F.col("chunk_id"))
    return stated.groupBy(*key).agg(F.min_by(F.struct("chunk_id", "limit"), order).alias("best")).select(*key, "best.chunk_id", "best.limit")


def limits_by_search(index: TermIndex, asked: DataFrame, chunks: DataFrame, top: int = 5, overrides: DataFrame | None = None) -> DataFrame:
    """The same from an index: for every (slug, sign_type, dimension, terms, units) a question, all at once, among the chunks of its city
    that may be cited; of the best ``top`` the first that states a limit decides. No other body is read.

    ``overrides`` (municipality_slug, sign_type, dimension, terms) are a city's own terms, which go before the rule's.
    """
    key = ["municipality_slug", "sign_type", "dimension"]
    if overrides is not None:
        own = overrides.select(*key, F.col("terms").alias("own_terms"))
        asked = asked.join(own, key, "left").withColumn("terms", F.coalesce("own_terms", "terms")).drop("own_terms")
    rules = cut(asked.select(*key, "terms", "units", F.xxhash64(*key).alias("query_id")), "rules")
    said = F.concat_ws(" ", F.slice("terms", 1, 2), F.col("dimension"), F.replace("sign_type", F.lit("_"), F.lit(" ")))
    words = rules.select("query_id", F.col("municipality_slug").alias("scope"), F.explode(tokens(said)).alias("term"))
    found = cut(index.search(words, top, _citable(chunks).select(F.col("chunk_id").alias("id"), F.col("municipality_slug").alias("scope"))), "rule-chunks")
    bodies = found.join(chunks.select(F.col("chunk_id").alias("id"), "body"), "id").join(rules, "query_id")
    stated = bodies.withColumn("limit", extract_limit(F.col("body"), F.col("units"))).filter("limit is not null")
    return stated.groupBy(*key).agg(F.min_by(F.struct(F.col("id").alias("chunk_id"), "limit"), "rank").alias("best")).select(*key, "best.chunk_id", "best.limit")


def check(specs: DataFrame, chunks: DataFrame, index: TermIndex | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """Verdicts of sign specs: spec_id, dimension, proposed, allowed, unit, chunk_id, verdict.

    ``specs``: spec_id, sign_type, municipality_slug, area, height, setback, frontage, in metres. Setbacks are least distances,
    the others most; a dimension not proposed is not checked; nothing stated, or a ratio without frontage, is indeterminate. With an
    ``index`` over the chunks' bodies limits are searched for in it, else among all chunks of a city.
    """
    proposed = specs.select("spec_id", "sign_type", "municipality_slug", "frontage", F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("double").alias("proposed")) for d in NUMERIC]))).filter("proposed is not null")
    rules = F.broadcast(rule_locations(specs.sparkSession))  # a fixed list
    asked = proposed.join(rules, ["sign_type", "dimension"])
    wanted = asked.select("municipality_slug", "sign_type", "dimension", "terms", "units").distinct()
    limits = governing_limits(wanted, chunks) if index is None else limits_by_search(index, wanted, chunks, overrides=overrides)
    rows = asked.drop("terms", "units", "is_ratio").join(limits, ["municipality_slug", "sign_type", "dimension"], "left")
    unit = F.col("limit.unit")
    metric = F.when(unit == "ft", 0.3048).when(unit == "ft2", 0.09290304).when(unit != "%", 1.0)
    allowed = F.col("limit.value") * metric * F.when(F.col("limit.is_ratio"), F.col("frontage")).otherwise(1.0)
    rows = rows.withColumn("allowed", allowed)
    fits = F.when(F.col("dimension") == "setback", F.col("proposed") >= F.col("allowed")).otherwise(F.col("proposed") <= F.col("allowed"))
    verdict = F.when(F.col("allowed").isNull(), "indeterminate").when(fits, "complies").otherwise("exceeds")
    return rows.select("spec_id", "dimension", "proposed", "allowed", unit.alias("unit"), "chunk_id", verdict.alias("verdict"))


def worst(verdict: Column) -> Column:
    """The gravest verdict of a group."""
    code = F.max(F.when(verdict == "exceeds", 2).when(verdict == "indeterminate", 1).otherwise(0))
    return F.element_at(F.array(*map(F.lit, ("complies", "indeterminate", "exceeds"))), code + 1)


def checklist(cities: DataFrame, chunks: DataFrame, top: int = 3, index: TermIndex | None = None) -> DataFrame:
    """Per city and topic: found, and the first of the ``top`` chunks that has a term. Topics are a fixed list.

    With an ``index`` each (city, topic) is a question, and of its best ``top`` chunks the first that has one of the terms counts.
    """
    topics = cities.select("municipality_slug", F.inline(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(t).alias("topic"), F.array(*map(F.lit, terms)).alias("terms")) for i, (t, terms) in enumerate(TOPICS)])))
    has = F.size(F.filter("terms", lambda t: F.contains(F.lower(F.col("body")), t)))
    if index is None:
        rows = topics.join(_citable(chunks).select("municipality_slug", "chunk_id", "body"), "municipality_slug")
        hits = rows.withColumn("hits", has).filter("hits > 0")
        ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("municipality_slug", "topic").orderBy(F.desc("hits"), "chunk_id"))).filter(F.col("rank") <= top)
    else:
        asked = cut(topics.withColumn("query_id", F.xxhash64("municipality_slug", "topic")), "topics")
        words = asked.select("query_id", F.col("municipality_slug").alias("scope"), F.explode(tokens(F.array_join("terms", " "))).alias("term"))
        found = cut(index.search(words, top, _citable(chunks).select(F.col("chunk_id").alias("id"), F.col("municipality_slug").alias("scope"))), "topic-chunks")
        ranked = found.join(chunks.select(F.col("chunk_id").alias("id"), "body"), "id").join(asked, "query_id").filter(has > 0).withColumnRenamed("id", "chunk_id")
    best = ranked.groupBy("municipality_slug", "topic").agg(F.min_by("chunk_id", "rank").alias("chunk_id"), F.count("*").alias("n_chunks"))
    return topics.select("municipality_slug", "position", "topic").join(best, ["municipality_slug", "topic"], "left").withColumn("found", F.col("chunk_id").isNotNull()).fillna(0, ["n_chunks"])


def compare(cities: DataFrame, chunks: DataFrame, sign_type: str, index: TermIndex | None = None) -> DataFrame:
    """Per dimension and city the limit, and whether it is the lowest or highest of those known; a dimension is comparable if two cities
    at least state one, all in the same unit and kind."""
    rules = rule_locations(cities.sparkSession).filter(F.col("sign_type") == sign_type).filter(F.col("dimension").isin(*NUMERIC))
    asked = cities.select("municipality_slug").join(F.broadcast(rules.drop("is_ratio")))  # a few dimensions for each city
    limits = governing_limits(asked, chunks) if index is None else limits_by_search(index, asked, chunks)
    rows = asked.select("municipality_slug", "dimension").join(limits, ["municipality_slug", "dimension"], "left").select("municipality_slug", "dimension", "limit.value", "limit.unit", "limit.is_ratio", "chunk_id")
    of_all = rows.groupBy("dimension").agg(F.count("value").alias("known"), ((F.min("unit") == F.max("unit")) & (F.min("is_ratio") == F.max("is_ratio"))).alias("same"), F.min("value").alias("low"), F.max("value").alias("high"))
    joined = rows.join(F.broadcast(of_all), "dimension")  # one row a dimension
    comparable = (F.col("known") >= 2) & F.coalesce("same", F.lit(False))
    return joined.select(*rows.columns, comparable.alias("comparable"), (comparable & F.coalesce(F.col("value") == F.col("low"), F.lit(False))).alias("lowest"), (comparable & F.coalesce(F.col("value") == F.col("high"), F.lit(False))).alias("highest"))
