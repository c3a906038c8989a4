"""An English suffix-stripping stemmer (the second Porter algorithm) and the stop words that full-text search leaves out."""

from __future__ import annotations

import functools
import re

# fixed values: words with stems of their own, and words that stay as they are
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_PLURAL = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
# fixed values: endings of the second, third and fourth step and what is put for them
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")
# fixed values: the stop words of English
STOP = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs
    themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as
    until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then
    once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should
    now""".split()
)

_VOWEL = "[aeiouy]"
_REGION = re.compile(rf"{_VOWEL}[^aeiouy]")
_OPENING = re.compile("gener|commun|arsen")
_SHORT_END = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_DOUBLE = re.compile("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")
_BEFORE_LI = "cdeghkmnrt"


def _regions(word: str) -> tuple[int, int]:
    """Where the regions begin that lie behind the first, and behind the next, consonant that follows a vowel."""
    opening = _OPENING.match(word)
    if opening:
        first = opening.end()
    else:
        found = _REGION.search(word)
        first = found.end() if found else len(word)
    found = _REGION.search(word, first)
    return first, found.end() if found else len(word)


def _ending(word: str, endings) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith(("us", "ss")):
        return word
    return word[:-1] if word.endswith("s") and re.search(_VOWEL, word[:-2]) else word


def _past(word: str, first: int) -> str:
    end = _ending(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        return word[: -len(end)] + "ee" if len(word) - len(end) >= first else word
    if not end or not re.search(_VOWEL, word[: -len(end)]):
        return word
    word = word[: -len(end)]
    if word.endswith(("at", "bl", "iz")):
        return word + "e"
    if _DOUBLE.search(word):
        return word[:-1]
    return word + "e" if first >= len(word) and _SHORT_END.search(word) else word


def _step_2(word: str, first: int) -> str:
    end = _ending(word, (*STEP_2, "ogi", "li"))
    if not end or len(word) - len(end) < first:
        return word
    before = word[: -len(end)]
    if end == "ogi":
        return before + "og" if before.endswith("l") else word
    if end == "li":
        return before if before[-1:] and before[-1] in _BEFORE_LI else word
    return before + STEP_2[end]


def _step_3(word: str, first: int, second: int) -> str:
    end = _ending(word, (*STEP_3, "ative"))
    if not end or len(word) - len(end) < first:
        return word
    if end == "ative":
        return word[:-5] if len(word) - 5 >= second else word
    return word[: -len(end)] + STEP_3[end]


def _step_4(word: str, second: int) -> str:
    end = _ending(word, (*STEP_4, "ion"))
    if not end or len(word) - len(end) < second or (end == "ion" and word[-4:-3] not in ("s", "t")):
        return word
    return word[: -len(end)]


def _last(word: str, first: int, second: int) -> str:
    if word.endswith("e"):
        at = len(word) - 1
        return word[:-1] if at >= second or (at >= first and not _SHORT_END.search(word[:-1])) else word
    if word.endswith("ll") and len(word) - 1 >= second:
        return word[:-1]
    return word


@functools.lru_cache(maxsize=100_000)
def english_stem(word: str) -> str:
    """The stem of a word of lower-case letters; words of other signs stay."""
    if len(word) <= 2 or not (word.isascii() and word.isalpha()):
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    word = re.sub(rf"(?:^y)|(?<={_VOWEL})y", "Y", word)
    first, second = _regions(word)
    word = _plural(word)
    if word in KEPT_AFTER_PLURAL:
        return word
    word = _past(word, first)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    word = _step_4(_step_3(_step_2(word, first), first, second), second)
    return _last(word, first, second).lower()
