"""Full-text match of web-style queries: terms, "phrases", OR, and -negation, as a column expression."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_PART = re.compile(r'(-?)"([^"]*)"?|(-?)(\S+)')


@dataclass(frozen=True)
class Clause:
    words: tuple[str, ...]
    negated: bool


def parse(query: str) -> list[list[Clause]]:
    """Alternatives, each a conjunction. OR binds what stands on both sides looser than the blank between terms."""
    groups: list[list[Clause]] = [[]]
    for m in _PART.finditer(query):
        if m[4] is not None and m[3] == "" and m[4].lower() == "or":
            if groups[-1]:
                groups.append([])
            continue
        words = tuple(re.findall("[a-z0-9]+", (m[2] if m[2] is not None else m[4]).lower()))
        if words:
            groups[-1].append(Clause(words, bool(m[1] or m[3])))
    return [g for g in groups if g]


def matches(text: Column, query: str) -> Column:
    """Whether a text satisfies the query; a query without words matches nothing."""
    hay = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "), F.lit(" "))
    found: Column = F.lit(False)
    for group in parse(query):
        fits: Column = F.lit(True)
        for clause in group:
            there = F.contains(hay, F.lit(f" {' '.join(clause.words)} "))
            fits = fits & (~there if clause.negated else there)
        found = found | fits
    return found
