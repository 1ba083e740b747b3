"""Porter's suffix stripping (1980) with the usual later extensions, over distinct terms."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Whole words with a stem of their own.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
#: Suffixes and what they become, by step; the first that fits is tried.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "fulli": "ful",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()

_ENDS2 = sorted(STEP2, key=len, reverse=True)
_ENDS3 = sorted(STEP3, key=len, reverse=True)
_ENDS4 = sorted(STEP4, key=len, reverse=True)
#: A word that ends with none of these, and isn't IRREGULAR, is its own stem.
ENDS = ("s", "ed", "ing", "y", "alli", "logi", *STEP2, *STEP3, *STEP4, "e", "ll")
#: Whether any suffix of a step fits is asked at once.
_ANY4 = tuple(STEP4)
_KINDS = {i: "c" for i in range(128)} | {ord(c): "v" for c in "aeiou"} | {ord("y"): "y"}


def _shape(word: str) -> str:
    """c and v for each letter; a y behind a consonant is a vowel."""
    kinds = word.translate(_KINDS) if word.isascii() else "".join("v" if c in "aeiou" else "y" if c == "y" else "c" for c in word)
    if "y" not in kinds:
        return kinds
    out = ""
    for i, kind in enumerate(kinds):
        out += kind if kind != "y" else "v" if i > 0 and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    """Runs of vowels with a consonant behind."""
    return _shape(stem).count("vc")


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y; or is a vowel and a consonant."""
    s = _shape(word)
    return (s.endswith("cvc") and word[-1] not in "wxy") or s == "vc"


def _drop(word: str, end: str) -> str:
    return word[: len(word) - len(end)]


def _plural(w: str) -> str:
    if w.endswith("ies"):
        return _drop(w, "ies") + ("ie" if len(w) == 4 else "i")
    if w.endswith("sses"):
        return _drop(w, "es")
    return _drop(w, "s") if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return _drop(w, "ied") + ("ie" if len(w) == 4 else "i")
    if w.endswith("eed"):
        return _drop(w, "d") if _measure(_drop(w, "eed")) > 0 else w
    for end in ("ed", "ing"):
        stem = _drop(w, end)
        if w.endswith(end):
            if "v" not in _shape(stem):
                return w
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _double(stem):
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem
    return w


def _table(w: str, ends: list[str], to: dict[str, str]) -> str:
    if not w.endswith(tuple(to)):
        return w
    for end in ends:
        if w.endswith(end):
            stem = _drop(w, end)
            return stem + to[end] if _measure(stem) > 0 else w
    return w


@functools.lru_cache(maxsize=262_144)
def porter(word: str) -> str:
    """The stem of one lower-cased word."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) < 3:
        return word
    w = _past(_plural(word))
    if w.endswith("y") and len(w) > 2 and _shape(w[:-1])[-1] == "c":
        w = w[:-1] + "i"
    if w.endswith("alli") and _measure(_drop(w, "alli")) > 0:
        w = _drop(w, "li")
    if w.endswith("logi"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        w = _table(w, _ENDS2, STEP2)
    w = _table(w, _ENDS3, STEP3)
    for end in _ENDS4 if w.endswith(_ANY4) else ():
        if w.endswith(end):
            stem = _drop(w, end)
            if _measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


@F.pandas_udf(T.StringType())
def _stem(terms: pd.Series) -> pd.Series:
    return terms.map(porter, na_action="ignore")


#: Lists of words that are stemmed at once.
LISTS = 1024


@F.arrow_udf(T.ArrayType(T.StringType()))
def _stem_all(lists: pa.Array) -> pa.Array:
    # the words stay in Arrow, only the distinct ones of a slice become Python strings
    return pa.concat_arrays([_stem_lists(lists.slice(i, LISTS)) for i in range(0, len(lists), LISTS)] or [lists])


def _stem_lists(lists: pa.Array) -> pa.Array:
    words = lists.flatten().dictionary_encode()
    stems = pa.array([None if w is None else porter(w) for w in words.dictionary.to_pylist()], words.dictionary.type)
    ends = np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, stems.take(words.indices), type=lists.type, mask=lists.is_null())


def stem(term: Column | str) -> Column:
    """The stems of a column of single words."""
    return _stem(term)


def stem_tokens(tokens: Column | str) -> Column:
    """The stems of arrays of words, in order; a worker keeps the stems of words it has seen."""
    return _stem_all(tokens)


def stem_terms(terms: DataFrame, column: str = "term") -> DataFrame:
    """One row for each distinct term with its stem; vocabularies are far smaller than texts."""
    return terms.select(column).distinct().withColumn("stem", stem(column))
