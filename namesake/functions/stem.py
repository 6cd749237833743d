"""Porter's stemmer, applied to distinct words."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_MEASURED = re.compile(f"^({_C})?{_V}{_C}")
_TWICE = re.compile(f"^({_C})?{_V}{_C}{_V}{_C}")
_ONCE = re.compile(f"^({_C})?{_V}{_C}({_V})?$")
_VOWEL = re.compile(f"^({_C})?[aeiouy]")
_CVC = re.compile(f"^{_C}[aeiouy][^aeiouwxy]$")

# The suffixes of the algorithm's second and third step, and those that its fourth drops.
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _swap(word: str, table: dict[str, str]) -> str:
    for end in sorted(table, key=len, reverse=True):
        if word.endswith(end):
            base = word[: -len(end)]
            return base + table[end] if _MEASURED.match(base) else word
    return word


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) < 3:
        return word
    first_y = word[0] == "y"
    w = "Y" + word[1:] if first_y else word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _MEASURED.match(w[:-3]):
            w = w[:-1]
    else:
        base = w[:-2] if w.endswith("ed") else w[:-3] if w.endswith("ing") else None
        if base is not None and _VOWEL.match(base):
            w = base
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeiouylsz":
                w = w[:-1]
            elif _CVC.match(w):
                w += "e"
    if w.endswith("y") and _VOWEL.match(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, SECOND), THIRD)
    for end in sorted(FOURTH, key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            if end in ("sion", "tion"):
                base += end[0]
            if _TWICE.match(base):
                w = base
            break
    if w.endswith("e") and (_TWICE.match(w[:-1]) or _ONCE.match(w[:-1]) and not _CVC.match(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _TWICE.match(w):
        w = w[:-1]
    return "y" + w[1:] if first_y else w


def stemmed(words: DataFrame, column: str = "word") -> DataFrame:
    """``words`` with ``stem``. Each distinct word is stemmed once and joined back."""
    stems = F.pandas_udf(lambda batch: batch.map(stem, na_action="ignore"), "string")
    table = words.select(column).distinct().withColumn("stem", stems(F.col(column)))
    return words.join(table, column)
