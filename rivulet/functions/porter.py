"""The Porter stemmer, after the published algorithm (M. F. Porter, 1980): suffix rules conditioned on the measure of the stem."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _pattern(word: str) -> str:
    """'c' and 'v' for every letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return _pattern(stem).count("vc")


def _short(stem: str) -> bool:
    """consonant-vowel-consonant at the end, the last not w, x or y."""
    return len(stem) >= 3 and _pattern(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _double(stem: str) -> bool:
    return len(stem) >= 2 and stem[-1] == stem[-2] and _pattern(stem)[-1] == "c"


# The suffix rules of steps 2 to 4.
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _replace(word: str, rules: list[tuple[str, str]]) -> str:
    """The rule with the longest fitting suffix applies, if the stem before it has a measure above 0."""
    fit = [r for r in rules if word.endswith(r[0])]
    if fit:
        suffix, new = max(fit, key=lambda r: len(r[0]))
        if _measure(word[: -len(suffix)]) > 0:
            return word[: -len(suffix)] + new
    return word


def stem(word: str) -> str:
    """Stem of a lower-case word; words of up to two letters stay."""
    if len(word) <= 2:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    cut = None
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    elif word.endswith("ed") and "v" in _pattern(word[:-2]):
        cut = word[:-2]
    elif word.endswith("ing") and "v" in _pattern(word[:-3]):
        cut = word[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")) or (_measure(cut) == 1 and _short(cut)):
            cut += "e"
        elif _double(cut) and cut[-1] not in "lsz":
            cut = cut[:-1]
        word = cut
    if word.endswith("y") and "v" in _pattern(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, STEP2), STEP3)
    fit = [s for s in STEP4 if word.endswith(s)]
    if fit:
        suffix = max(fit, key=len)
        rest = word[: -len(suffix)]
        if _measure(rest) > 1 and (suffix != "ion" or rest.endswith(("s", "t"))):
            word = rest
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _short(rest)):
            word = rest
    if _measure(word) > 1 and _double(word) and word.endswith("l"):
        word = word[:-1]
    return word


def _stems(words: pd.Series) -> pd.Series:
    known = {w: stem(w) for w in words.dropna().unique()}
    return words.map(known)


_stems.__annotations__ = {"words": pd.Series, "return": pd.Series}


def stem_column(c: Column) -> Column:
    return F.pandas_udf(_stems, "string")(c)
