"""Numeric limits out of rule text: value, unit and whether it is a ratio of the frontage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketspark.functions.text import bound, clauses

# fixed values: unit spellings and the canonical unit
UNITS = {
    "square metre": "m2",
    "square metres": "m2",
    "square meter": "m2",
    "square meters": "m2",
    "sq m": "m2",
    "sq. m": "m2",
    "m2": "m2",
    "metre": "m",
    "metres": "m",
    "meter": "m",
    "meters": "m",
    "m": "m",
    "square foot": "ft2",
    "square feet": "ft2",
    "sq ft": "ft2",
    "ft2": "ft2",
    "foot": "ft",
    "feet": "ft",
    "ft": "ft",
    "percent": "%",
    "per cent": "%",
    "%": "%",
}

# fixed values: phrases that set a maximum, that make it one of the frontage, and that put it elsewhere
MAXIMUM = ("shall not exceed", "must not exceed", "no greater than", "not more than", "no more than", "maximum", "up to")
EACH = ("per", "for each", "/")
LENGTHS = ("metre", "meter", "m", "foot", "ft")
FRONTAGE = ("frontage", "width", "store front", "storefront", "building face")
ELSEWHERE = ("as set out in", "in accordance with", "specified in", "as provided in", "pursuant to", "refer to")
PLACES = ("schedule", "section", "table", "part", "appendix")


def _any(phrases, group: str = "?:") -> str:
    """One of the phrases, the longest first, with white space of any length between words."""
    forms = [r"\s+".join(w.replace(".", r"\.") for w in p.split()) for p in sorted(phrases, key=len, reverse=True)]
    return f"({group}{'|'.join(forms)})"


_QUANTITY = r"(?i)(\d+(?:,\d{3})*(?:[.,]\d+)?)\s*" + _any(UNITS, "") + r"(?!\w)"
#: How many words before or behind a quantity may hold the phrase that makes it a limit: half a line.
NEAR = 9


def _has(words: Column, phrases: tuple[str, ...], at_start: bool = False) -> Column:
    """Whether words that are joined by blanks, with one at either end, hold one of the phrases; or begin with it."""
    return F.exists(F.array(*[F.lit(f" {p} ") for p in phrases]), lambda p: F.startswith(words, p) if at_start else F.contains(words, p))


def _spoken(text: Column) -> Column:
    """Lower-cased words, joined by blanks, with one at either end; a slash is a word."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("/"), F.lit(" / ")), r"[^\p{L}\p{N}/%-]+", " ")), F.lit(" "))


def _first_words(spoken: Column, n: int) -> Column:
    return F.concat(F.substring_index(spoken, " ", n + 1), F.lit(" "))


def _last_words(spoken: Column, n: int) -> Column:
    return F.concat(F.lit(" "), F.substring_index(spoken, " ", -n - 1))


def limits_in(sentence: Column) -> Column:
    """array<struct<raw, unit, is_ratio>> of a sentence's limits, in order.

    Quantities part the sentence. One is a limit if, among the last words before it and behind any other number or stop, there is a phrase
    that sets a maximum; and one of the frontage if the words behind it begin with a word of measure and go on to a length and a frontage.
    """
    units = F.create_map(*[F.lit(v) for pair in UNITS.items() for v in pair])
    found = F.zip_with(F.regexp_extract_all(sentence, F.lit(_QUANTITY), F.lit(1)), F.regexp_extract_all(sentence, F.lit(_QUANTITY), F.lit(2)), lambda raw, unit: F.struct(raw.alias("raw"), F.try_element_at(units, F.regexp_replace(F.lower(unit), r"\s+", " ")).alias("unit")))

    def judged(x: Column, i: Column, between: Column) -> Column:
        before = _last_words(_spoken(F.regexp_replace(F.get(between, i), r"(?s)^.*[\d.;]", "")), NEAR)
        behind = _first_words(_spoken(F.get(between, i + 1)), NEAR)
        ratio = bound(behind, lambda words: _has(words, EACH, at_start=True) & _has(words, LENGTHS) & _has(words, FRONTAGE))
        limit = bound(before, lambda words: _has(words, MAXIMUM))
        return bound(ratio, lambda r: F.struct(x["raw"].alias("raw"), x["unit"].alias("unit"), r.alias("is_ratio"), (r | limit).alias("is_limit")))

    every = bound(F.split(sentence, _QUANTITY), lambda between: F.transform(found, lambda x, i: judged(x, i, between)))
    return F.filter(every, lambda x: x["is_limit"] & x["unit"].isNotNull())


def defers(sentence: Column) -> Column:
    """Whether a sentence says that the limit stands elsewhere: soon after a phrase of reference comes a part of a document."""

    def refers(spoken: Column, phrase: Column) -> Column:
        behind = F.slice(F.split(spoken, phrase), 2, 1000)
        return F.contains(spoken, phrase) & F.exists(behind, lambda rest: bound(_first_words(F.concat(F.lit(" "), rest), NEAR), lambda words: _has(words, PLACES)))

    return bound(_spoken(sentence), lambda spoken: F.exists(F.array(*[F.lit(f" {p} ") for p in ELSEWHERE]), lambda phrase: refers(spoken, phrase)))


RANGE = r"(?i)\bbetween\s+\d\S*\s+(?:[a-z²]+\s+)?and\s+\d"


def extract_limit(text: Column, expected: Column | None = None) -> Column:
    """struct(value, unit, is_ratio, sentence) of the first sentence that states a limit in an expected unit, else null.

    A limit that is a ratio of the frontage goes before the sentence's others. ``m²`` is read as m2; ``25%`` counts; ``1,000`` is a thousand,
    ``9,3`` has a decimal comma. Sentences that refer to another place or give a range state none.
    """

    def first(right: Column) -> Column:
        return F.coalesce(F.get(F.filter(right, lambda x: x["is_ratio"]), F.lit(0)), F.get(right, F.lit(0)))

    def of(sentence: Column) -> Column:
        right = F.filter(limits_in(sentence), lambda x: F.lit(True) if expected is None else (F.size(expected) == 0) | F.array_contains(expected, x["unit"]))
        return F.when(~defers(sentence) & ~sentence.rlike(RANGE), F.struct(bound(right, first).alias("limit"), sentence.alias("sentence")))

    def read(found: Column) -> Column:
        raw = found["limit"]["raw"]
        plain = F.when(raw.rlike(r"^\d{1,3}(?:,\d{3})+"), F.replace(raw, F.lit(","), F.lit(""))).otherwise(F.replace(raw, F.lit(","), F.lit(".")))
        return F.when(found.isNotNull(), F.struct(plain.try_cast("double").alias("value"), found["limit"]["unit"].alias("unit"), found["limit"]["is_ratio"].alias("is_ratio"), found["sentence"].alias("sentence")))

    readable = F.replace(F.coalesce(text, F.lit("")), F.lit("²"), F.lit("2"))
    found = F.filter(F.transform(clauses(readable), of), lambda x: x["limit"].isNotNull())
    return bound(F.get(found, F.lit(0)), read)
