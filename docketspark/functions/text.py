"""Scalar text functions as column expressions. Java's ``(?U)`` makes word characters and white space Unicode."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"(?U)\s"


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``x``, which is evaluated once a row, however often ``f`` uses it: inside lambdas and branches Spark shares nothing."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, rf"(?U)^\s+|\s+$", "")


def squeeze(x: Column) -> Column:
    return strip(F.regexp_replace(x, rf"(?U)\s+", " "))


def normalise(x: Column) -> Column:
    """White space collapsed, lower case, sharp s as ss: for comparing quotes."""
    return F.replace(F.lower(squeeze(x)), F.lit("ß"), F.lit("ss"))


def estimate_tokens(x: Column) -> Column:
    """Length over 3.6, half to even, at least 1; 0 for the empty text."""
    n = F.length(x)
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.bround(n / 3.6).cast("int")))


def content_hash(x: Column) -> Column:
    return F.sha2(x, 256)


#: Accented letters and what they fold to, a rule of decomposition for Latin text.
_FOLDS = {"a": "àáâãäåā", "c": "çćč", "e": "èéêëēėę", "i": "ìíîïī", "n": "ñń", "o": "òóôõöō", "u": "ùúûüū", "y": "ýÿ", "s": "š", "z": "žź"}


def fold(x: Column) -> Column:
    """Lower case without accents, composed or not, and without a province at the end."""
    plain = F.regexp_replace(F.lower(x), r"\p{M}+", "")
    plain = F.translate(plain, "".join(_FOLDS.values()), "".join(k * len(v) for k, v in _FOLDS.items()))
    return F.regexp_replace(strip(plain), r",?\s*\b(?:b\.?c\.?|british\s+columbia|canada)\b\.?$", "")


def dashed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, "[^a-z0-9]+", "-"), F.lit("-"))


def qualify(x: Column) -> Column:
    """Key that keeps the incorporation prefix."""
    return dashed(fold(x))


_PREFIX = r"^(?:the\s+)?(?:city|corporation|district|township|town|village|resort\s+municipality|island\s+municipality|municipality|regional\s+district)\s+of\s+"


def slugify(x: Column) -> Column:
    """Key without the incorporation prefix."""
    return dashed(F.regexp_replace(fold(x), _PREFIX, ""))


def model_slug(x: Column) -> Column:
    """The last part of a model's path as a name."""
    return dashed(F.lower(F.element_at(F.split(x, "/"), -1)))


# fixed values: long forms and the abbreviations that open data uses
ABBREVIATIONS = {
    "street": "st",
    "avenue": "ave",
    "road": "rd",
    "drive": "dr",
    "boulevard": "blvd",
    "crescent": "cres",
    "place": "pl",
    "court": "crt",
    "highway": "hwy",
    "parkway": "pkwy",
    "terrace": "terr",
    "north": "n",
    "south": "s",
    "east": "e",
    "west": "w",
    "northwest": "nw",
    "northeast": "ne",
    "southwest": "sw",
    "southeast": "se",
}


def normalise_address(x: Column) -> Column:
    """A stable key: accents, punctuation and case go, street types and directions are abbreviated."""
    short = F.create_map(*[F.lit(v) for pair in ABBREVIATIONS.items() for v in pair])
    plain = F.translate(F.regexp_replace(F.lower(x), r"\p{M}+", ""), "".join(_FOLDS.values()), "".join(k * len(v) for k, v in _FOLDS.items()))
    tokens = F.split(F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " ")), " ")
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(short, t), t)), " ")


# fixed values: date forms in the order they are tried
DATE_FORMATS = ("MMMM d, yyyy", "MMMM d yyyy", "MMM d, yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy", "yyyy-M-d", "yyyy/M/d")
MONTH_FORMATS = ("d MMMM yyyy", "d MMM yyyy")


def parse_date(x: Column) -> Column:
    """A date in one of the usual forms; a month alone is its first day."""

    def read(cased: Column) -> Column:
        tries = [F.try_to_date(cased, f) for f in DATE_FORMATS] + [F.try_to_date(F.concat(F.lit("1 "), cased), f) for f in MONTH_FORMATS]
        return F.when(cased.rlike("[0-9]"), F.coalesce(*tries))  # every form has digits, and a form that fails costs most

    return bound(F.initcap(F.regexp_replace(squeeze(x), r"\.$", "")), read)


def bylaw_key(x: Column) -> Column:
    """Bylaw number for comparing: what precedes a dash, without leading zeros; null if nothing is left."""
    return F.nullif(F.ltrim(F.trim(F.element_at(F.split(x, "[-–]"), 1)), F.lit("0")), F.lit(""))


def roman(x: Column) -> Column:
    """Value of a roman numeral, null if it is none."""
    values = F.create_map(*[F.lit(v) for pair in {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}.items() for v in pair])
    digits = F.transform(F.reverse(F.split(F.lower(x), "")), lambda c: F.coalesce(F.try_element_at(values, c), F.lit(0)))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("high"))
    total = F.aggregate(digits, start, lambda s, d: F.struct((s["total"] + F.when(d < s["high"], -d).otherwise(d)).alias("total"), F.greatest(s["high"], d).alias("high")))["total"]
    return F.when(F.lower(x).rlike("^[ivxlcdm]+$"), F.nullif(total, F.lit(0)))


def eval_section(x: Column) -> Column:
    """Section numbers as an evaluation compares them."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(x)), r"^(?:section|sec\.?|s\.)\s*", ""), r"[\s.]+$", "")


_SENTENCE = r"(?<=[.!?])\s+(?=[A-Z(\[])"


def sentences(x: Column) -> Column:
    """Split where a sentence sign, white space and a capital, bracket or parenthesis meet."""
    return F.filter(F.transform(F.split(x, _SENTENCE), strip), lambda s: s != "")


def clauses(x: Column) -> Column:
    """Split after full stops and semicolons."""
    return F.filter(F.transform(F.split(x, r"(?<=[.;])\s+"), strip), lambda s: s != "")


def first_sentences(x: Column, most: int = 320) -> Column:
    """Whole text if short enough, else cut after the last full stop that fits, else at the limit."""
    head = F.substring(x, 1, most)
    return F.when(F.length(x) <= most, x).when(F.instr(head, ". ") > 0, F.regexp_extract(head, r"(?s)^(.*\.) ", 1)).otherwise(head)


def truncate(x: Column, most: int) -> Column:
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.substring(x, 1, most - 1), F.lit("…")))


def citation_label(bylaw: Column, section: Column, page: Column) -> Column:
    return F.concat_ws(", ", F.concat(F.lit("Bylaw No. "), bylaw), F.concat(F.lit("s. "), F.nullif(section, F.lit(""))), F.concat(F.lit("p. "), page.cast("string")))


def quote_in(quote: Column, body: Column, least_words: int = 8) -> Column:
    """The quote stands in the body; of a long one, its first two thirds do."""
    needle, hay = normalise(quote), normalise(body)
    words = F.split(needle, " ")
    n = F.size(words)
    head = F.array_join(F.slice(words, 1, F.greatest(F.lit(6), F.floor(n * 2 / 3).cast("int"))), " ")
    return F.when(needle == "", False).otherwise(F.contains(hay, needle) | ((n >= least_words) & F.contains(hay, head)))


# fixed values: words of obligation, openings of sentences that claim nothing, units of a number
OBLIGATION = r"(?i)\b(must|shall|may not|cannot|can not|is not permitted|are not permitted|is permitted|are permitted|is allowed|are allowed|is prohibited|are prohibited|requires?|required|maximum|minimum|no more than|no less than|up to|limited to|exceed)\b"
OPENINGS = ("the excerpt", "the excerpts", "the bylaw", "the bylaws", "the document", "the documents", "the provided", "i cannot", "i could not", "i don't", "i do not", "this depends", "this varies", "note that", "however", "based on", "according to")
NUMBER_UNITS = ("%", "percent", "m", "mm", "cm", "metre", "metres", "meter", "meters", "ft", "feet", "foot", "in", "inches", "sq m", "sq. m", "square metre", "square metres", "square meter", "square meters")
NON_CLAIM = rf"(?i)^\s*(?:{'|'.join(OPENINGS)})(?!\w)"
MARKER = r"\[S(\d+)\]"
NUMBER = r"\b\d+(?:[.,]\d+)?\s*(?:" + "|".join(u.replace(".", r"\.").replace(" ", r"\s*") for u in sorted(NUMBER_UNITS, key=len, reverse=True)) + ")?"


def uncited_claims(answer: Column) -> Column:
    """Sentences that state an obligation and carry no source marker."""
    return F.filter(sentences(answer), lambda s: ~s.rlike(NON_CLAIM) & s.rlike(OBLIGATION) & ~s.rlike(MARKER))


def regulatory_digits(token: Column) -> Column:
    """Digits of a number that may be a rule's: no years and no large integers."""
    digits = F.regexp_replace(token, r"[^\d.]", "")
    value = F.try_to_number(digits, F.lit("999999999999.999999"))
    whole = ~F.contains(digits, F.lit("."))
    return F.when((digits != "") & ~(whole & (value.between(1800, 2200) | (value > 9999))), digits)


def ungrounded_numbers(answer: Column, cited: Column, by_token: bool = True) -> Column:
    """Numbers of the answer that the cited text lacks, in order, each once. ``by_token``: 5 is not grounded by 15."""
    hay = F.replace(normalise(cited), F.lit(","), F.lit(""))
    tokens = F.transform(F.regexp_extract_all(answer, F.lit(NUMBER), F.lit(0)), strip)

    def absent(t):
        digits = regulatory_digits(t)
        there = F.contains(F.concat(F.lit(" "), F.regexp_replace(hay, r"[^0-9.]+|\.(?![0-9])", " "), F.lit(" ")), F.concat(F.lit(" "), digits, F.lit(" "))) if by_token else F.contains(hay, digits)
        return digits.isNotNull() & ~there

    return F.when(cited == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(tokens, absent)))


def json_object(x: Column) -> Column:
    """The outermost braces of a model's reply, whatever fence or talk stands around."""
    return F.nullif(F.regexp_extract(x, r"(?s)(\{.*\})", 1), F.lit(""))


def render_markdown(rows: Column) -> Column:
    """A table, its first row the header, as markdown; ragged rows are filled up."""

    def line(r, width):
        cells = F.transform(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), lambda c: F.replace(squeeze(F.coalesce(c, F.lit(""))), F.lit("|"), F.lit("\\|")))
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def table(width):
        rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width))
        lines = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: line(r, width))
        return F.array_join(F.concat(F.array(line(F.element_at(rows, 1), width)), F.array(rule), lines), "\n")

    return bound(F.array_max(F.transform(rows, lambda r: F.size(r))), table)


def degenerate_table(rows: Column) -> Column:
    """Fewer than two rows or columns, or under 30 % of the cells filled."""
    cells = F.flatten(rows)
    filled = F.size(F.filter(cells, lambda c: c.isNotNull() & (strip(c) != "")))
    return (F.size(rows) < 2) | (F.array_max(F.transform(rows, lambda r: F.size(r))) < 2) | (filled < 0.3 * F.size(cells))


def page_quality(text: Column, min_chars: int = 120) -> dict[str, Column]:
    """How far a page's text layer can be trusted: n_chars, bad_ratio, plausibility, confidence.

    Words are counted by two patterns: all runs of two letters and more, and those of over 40 or of over 6 without a vowel.
    The weights and bounds of the score are fixed values.
    """
    body = strip(F.coalesce(text, F.lit("")))
    n = F.length(body)
    bad = F.regexp_count(body, F.lit("[\\x{FFFD}\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]")) / F.greatest(n, F.lit(1))
    words = F.regexp_count(body, F.lit("[A-Za-z]{2,}+"))
    odd = F.regexp_count(body, F.lit("(?<![A-Za-z])(?:[A-Za-z]{41,}+|[B-DF-HJ-NP-TV-XZb-df-hj-np-tv-xz]{7,}+(?![A-Za-z]))"))
    share = F.when(words == 0, 0.0).otherwise((words - odd) / words)
    density = F.least(F.lit(1.0), n / max(1, 4 * min_chars))
    score = (
        F.when(n == 0, 0.0)
        .when(n < min_chars, F.bround(0.4 * density, 3))
        .when(bad > 0.05, F.bround(F.greatest(F.lit(0.0), 0.4 - bad), 3))
        .when(share < 0.5, F.bround(0.8 * share, 3))
        .otherwise(F.bround(F.least(F.lit(1.0), 0.55 + 0.25 * density + 0.2 * share - bad), 3))
    )
    return {"n_chars": n, "bad_ratio": bad, "plausibility": share, "confidence": score}
