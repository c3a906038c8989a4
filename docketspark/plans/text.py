"""Text functions over ``documents``, and over texts that the rows of other tables write where ``documents`` holds no such text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketspark.functions import limits as L
from docketspark.functions import text as T
from docketspark.plans.registry import query
from docketspark.session import dealt, spread, table


def rows(spark: SparkSession, schema: str, *values: tuple) -> DataFrame:
    """A few literal rows."""
    return spark.createDataFrame(list(values), schema)


def values(*rows_: tuple) -> str:
    """The same rows as SQL."""

    def one(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        return str(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows_)


def _number(key):
    return (key % 900 + 100).cast("string")  # three digits


def each(spark: SparkSession, d: str, schema: str, *written: tuple, name: str = "customer", key: str = "c_custkey") -> DataFrame:
    """Every row of a table writes one of the texts, by its number: key and the columns of ``schema``; ``#`` is a number of three digits of its own."""
    given = rows(spark, f"position int, {schema}", *[(i, *x) for i, x in enumerate(written)])
    joined = dealt(table(spark, d, name).select(F.col(key).alias("key"))).join(F.broadcast(given), F.col("key") % len(written) == F.col("position"))  # a few texts
    return joined.select("key", *[F.replace(f.name, F.lit("#"), _number(F.col("key"))).alias(f.name) if f.dataType.typeName() == "string" else f.name for f in given.schema[1:]])


def each_sql(names: str, *expected: tuple, name: str = "customer", key: str = "c_custkey") -> str:
    """What is expected of every row, as a subquery of key and ``names``."""
    columns = names.split(", ")
    text = [c if not any(isinstance(x[i], str) for x in expected) else f"replace({c}, '#', CAST({key} % 900 + 100 AS VARCHAR)) AS {c}" for i, c in enumerate(columns)]
    return f"(SELECT {key} AS key, {', '.join(text)} FROM {name} JOIN (VALUES {values(*[(i, *x) for i, x in enumerate(expected)])}) t(position, {names}) ON {key} % {len(expected)} = position)"


def every(spark: SparkSession, d: str, schema: str, *written: tuple, name: str = "supplier", key: str = "s_suppkey") -> DataFrame:
    """Every row of a table writes all of the rows; ``#`` as above."""
    given = rows(spark, schema, *written)
    all_of = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(x, given.schema, strict=True)]) for x in written])
    out = dealt(table(spark, d, name).select(F.col(key).alias("key"))).select("key", F.inline(all_of))
    return out.select("key", *[F.replace(f.name, F.lit("#"), _number(F.col("key"))).alias(f.name) if f.dataType.typeName() == "string" else f.name for f in given.schema])


def every_sql(names: str, *expected: tuple, name: str = "supplier", key: str = "s_suppkey") -> str:
    columns = names.split(", ")
    text = [c if not any(isinstance(x[i], str) for x in expected) else f"replace({c}, '#', CAST({key} % 900 + 100 AS VARCHAR)) AS {c}" for i, c in enumerate(columns)]
    return f"(SELECT {key} AS key, {', '.join(text)} FROM {name} CROSS JOIN (VALUES {values(*expected)}) t({names}))"


@query("""SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE CAST(greatest(1, round_even(length(text) / 3.6, 0)) AS INTEGER) END AS n_tokens, sha256(text) AS hash FROM documents""")
def token_estimate_and_hash(spark, d):
    """Estimated tokens and content hash of every document."""
    return table(spark, d, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("n_tokens"), T.content_hash(F.col("text")).alias("hash"))


@query(r"""WITH b AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
       w AS (SELECT doc_id, length(t) AS n, len(regexp_extract_all(t, '[\x{FFFD}\x00-\x08\x0b\x0c\x0e-\x1f]')) / greatest(length(t), 1) AS bad, regexp_extract_all(t, '[A-Za-z]{2,}') AS ws FROM b),
       q AS (SELECT doc_id, n, bad, CASE WHEN len(ws) = 0 THEN 0.0 ELSE len(list_filter(ws, lambda w: length(w) <= 40 AND (length(w) <= 6 OR regexp_matches(w, '[aeiouyAEIOUY]')))) / len(ws) END AS p, least(1.0, n / 480) AS dens FROM w)
       SELECT doc_id, n AS n_chars, round(p, 6) AS plausibility, CASE WHEN n = 0 THEN 0.0 WHEN n < 120 THEN round_even(0.4 * dens, 3) WHEN bad > 0.05 THEN round_even(greatest(0, 0.4 - bad), 3)
         WHEN p < 0.5 THEN round_even(0.8 * p, 3) ELSE round_even(least(1.0, 0.55 + 0.25 * dens + 0.2 * p - bad), 3) END AS confidence FROM q""", n_chars="INTEGER")
def page_quality(spark, d):
    """Quality of every text layer."""
    q = T.page_quality(F.col("text"))
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", q["n_chars"].alias("n_chars"), F.round(q["plausibility"], 6).alias("plausibility"), q["confidence"].alias("confidence"))


@query(r"""SELECT doc_id, len(list_filter(string_split_regex(regexp_replace(text, '([.!?])\s+([A-Z(\[])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g') <> '')) AS n_sentences FROM documents""")
def sentence_split(spark, d):
    """Sentences of every document."""
    return table(spark, d, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n_sentences"))


@query(r"""SELECT item_id, count(*) AS n_documents FROM benchmark JOIN documents ON contains(
         lower(regexp_replace(regexp_replace(documents.text, '\s+', ' ', 'g'), '^ | $', '', 'g')), lower(regexp_replace(regexp_replace(benchmark.text, '\s+', ' ', 'g'), '^ | $', '', 'g'))) GROUP BY 1""")
def quote_verification(spark, d):
    """Stated quotes against every body: the quotes are a stated set, taken in blocks, beside the documents they are compared with."""
    from docketspark.operators.verify import quotes_found

    found = quotes_found(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "text", "item_id", "text")
    return found.groupBy("item_id").agg(F.count("*").alias("n_documents"))


_LIMITS = [
    ("The maximum height of a pylon sign is #.5 m.", "", "#.5", "m", False),
    ("Sign area shall not exceed 0.# square metres per metre of building frontage.", "", "0.#", "m2", True),
    ("Window signs shall not exceed # percent of the window area.", "", "#", "%", False),
    ("Maximum sign area shall be as set out in Schedule B.", "", None, None, None),
    ("Freestanding signs shall be located between #.4 and 4.5 metres from the property line.", "", None, None, None),
    ("A fascia sign shall not exceed #.3 square metres.", "m", None, None, None),
    ("The area shall not exceed #.3 m².", "", "#.3", "m2", False),
    ("The height shall not exceed #,3 metres.", "", "#.3", "m", False),
    ("Coverage up to #% of the glazing.", "", "#", "%", False),
    ("A sign shall not exceed #,000 square feet.", "", "#000", "ft2", False),
    ("See Part 3 in accordance with section 4; the height must not exceed # m.", "m,ft", "#", "m", False),
    ("", "", None, None, None),
]


@query(f"SELECT key, value, unit, is_ratio FROM {each_sql('value, unit, is_ratio', *[x[2:] for x in _LIMITS])}", value="DOUBLE")
def extract_limits(spark, d):
    """Limits of rule sentences that customers' numbers stand in."""
    given = each(spark, d, "text string, units string", *[x[:2] for x in _LIMITS])
    found = L.extract_limit(F.col("text"), F.filter(F.split("units", ","), lambda u: u != ""))
    return given.select("key", found.alias("f")).select("key", "f.value", "f.unit", "f.is_ratio")


_NAMES = [
    ("City of Coquitlam #", "city-of-coquitlam-#", "coquitlam-#"),
    ("COQUITLAM #", "coquitlam-#", "coquitlam-#"),
    ("Coquitlam, B.C.", "coquitlam", "coquitlam"),
    ("Township of Langley/#", "township-of-langley-#", "langley-#"),
    ("Montréal-Ouest  #", "montreal-ouest-#", "montreal-ouest-#"),
    ("The Corporation of Delta", "the-corporation-of-delta", "delta"),
    ("Hudson's Hope #", "hudson-s-hope-#", "hudson-s-hope-#"),
    ("  Fort St. John, British Columbia", "fort-st-john", "fort-st-john"),
]


@query(f"SELECT key, qualified, slug FROM {each_sql('qualified, slug', *[x[1:] for x in _NAMES])}")
def slugify_names(spark, d):
    """Keys of names with and without the incorporation prefix."""
    return each(spark, d, "name string", *[x[:1] for x in _NAMES]).select("key", T.qualify(F.col("name")).alias("qualified"), T.slugify(F.col("name")).alias("slug"))


@query("""SELECT p_partkey, 'city-of-' || s AS qualified, s AS slug FROM (SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM part)""")
def name_slugs(spark, d):
    """Keys of all parts' names, with and without a prefix."""
    name = F.concat(F.lit("City of "), F.col("p_name"), F.lit(" "), F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", T.qualify(name).alias("qualified"), T.slugify(name).alias("slug"))


_STREETS = [
    ("# Main Street North, Unit 4", "# main st n unit 4"),
    ("#-A Élan Boulevard", "# a elan blvd"),
    ("9 Northwest Parkway, Suite #", "9 nw pkwy suite #"),
]


@query(f"SELECT key, address_key FROM {each_sql('address_key', *[x[1:] for x in _STREETS])}")
def address_keys(spark, d):
    """Cache keys of customers' addresses."""
    return each(spark, d, "address string", *[x[:1] for x in _STREETS]).select("key", T.normalise_address(F.col("address")).alias("address_key"))


_DATES = [
    ("July 15, 2021", "2021-07-15"),
    ("july 15 2021", "2021-07-15"),
    ("Jul 5, 2021", "2021-07-05"),
    ("15 July 2021", "2021-07-15"),
    ("2021-7-5", "2021-07-05"),
    ("2021/07/15", "2021-07-15"),
    ("July 2019", "2019-07-01"),
    ("Feb 2019.", "2019-02-01"),
    ("sometime", None),
    ("February 30, 2020", None),
]


@query(f"SELECT key, CAST(day AS DATE) AS day FROM {each_sql('day', *[x[1:] for x in _DATES])}")
def loose_dates(spark, d):
    """Dates as bylaws write them, one of each customer."""
    return each(spark, d, "text string", *[x[:1] for x in _DATES]).select("key", T.parse_date(F.col("text")).alias("day"))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS long_day, CAST(o_orderdate AS DATE) AS short_day, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, nullif(ltrim(CAST(o_orderkey AS VARCHAR), '0'), '') AS key FROM orders""")
def order_dates_read(spark, d):
    """All orders' dates written out in three forms and read back, and their numbers written as bylaws write them."""
    day, number = F.col("o_orderdate"), F.col("o_orderkey")
    forms = {"long_day": "MMMM d, yyyy", "short_day": "d MMM yyyy", "month": "MMMM yyyy"}
    key = T.bylaw_key(F.format_string("%010d-%d", number, F.year(day)))
    return table(spark, d, "orders").select("o_orderkey", *[T.parse_date(F.date_format(day, f)).alias(n) for n, f in forms.items()], key.alias("key"))


_NUMBERS = [("#", "#", None), ("0#-2019", "#", None), ("#–2020", "#", None), ("0", None, None), ("iv", "iv", 4), ("XIX", "XIX", 19), ("mcmxc", "mcmxc", 1990), ("abc", "abc", None)]


@query(f"SELECT key, bylaw, CAST(roman AS INTEGER) AS roman FROM {each_sql('bylaw, roman', *[x[1:] for x in _NUMBERS])}")
def bylaw_numbers(spark, d):
    """Bylaw numbers for comparing, and roman numerals."""
    return each(spark, d, "raw string", *[x[:1] for x in _NUMBERS]).select("key", T.bylaw_key(F.col("raw")).alias("bylaw"), T.roman(F.col("raw")).alias("roman"))


_ANSWERS = [
    ("Signs must not exceed #.3 m [S1]. The permit is required. However, fees may vary.", "The height is #.3 m.", "The permit is required.", ""),
    ("The limit is # m in 2019.", "A height of 1# metres applies.", "", "# m"),
    ("The sign shall be #.5 m and 2.0 m. Based on this it must stop.", "At most #.5 m", "The sign shall be #.5 m and 2.0 m.", "2.0 m"),
    ("It may be # m.", "", "", ""),
]


@query(f"SELECT key, uncited, ungrounded FROM {each_sql('uncited, ungrounded', *[x[2:] for x in _ANSWERS])}")
def number_grounding(spark, d):
    """Uncited claims and ungrounded numbers of answers that customers' numbers stand in."""
    given = each(spark, d, "answer string, cited string", *[x[:2] for x in _ANSWERS])
    return given.select("key", F.array_join(T.uncited_claims(F.col("answer")), "|").alias("uncited"), F.array_join(T.ungrounded_numbers(F.col("answer"), F.col("cited")), "|").alias("ungrounded"))


_REPLIES = [('```json\n{"answer": "x#", "n": #}\n```', "x#", "#"), ('so {"answer": "y#"} it is', "y#", None), ("no object #", None, None), ('{"n": #, "answer": "}"}', "}", "#")]


@query(f"SELECT key, answer, n FROM {each_sql('answer, n', *[x[1:] for x in _REPLIES])}", n="INTEGER")
def tolerant_json(spark, d):
    """A model's reply read whatever stands around its object."""
    found = F.from_json(T.json_object(F.col("reply")), "answer string, n int")
    return each(spark, d, "reply string", *[x[:1] for x in _REPLIES]).select("key", found["answer"].alias("answer"), found["n"].alias("n"))


_GRIDS = [
    ("Zone;Max/C-#; #.3~ m/C-2", "| Zone | Max |~| --- | --- |~| C-# | #.3 m |~| C-2 |  |", False),
    ("only #", "| only # |~| --- |", True),
    ("a;b;c/;;/;#;", "| a | b | c |~| --- | --- | --- |~|  |  |  |~|  | # |  |", False),
]


@query(f"SELECT key, replace(markdown, '~', chr(10)) AS markdown, degenerate FROM {each_sql('markdown, degenerate', *[x[1:] for x in _GRIDS])}")
def table_markdown(spark, d):
    """Tables that customers' numbers stand in as markdown, and those too poor to keep."""
    grid = F.transform(F.split(F.replace("grid", F.lit("~"), F.lit("\n")), "/"), lambda r: F.split(r, ";"))
    given = each(spark, d, "grid string", *[x[:1] for x in _GRIDS]).withColumn("rows", grid)
    return given.select("key", T.render_markdown(F.col("rows")).alias("markdown"), T.degenerate_table(F.col("rows")).alias("degenerate"))
