"""English stemmer after the published "Porter2" description, and the use of stemmers over columns.

Spark has no stemmer.  ``stem_column`` is an Arrow UDF with a memo of its own, for distinct terms.  ``stem_tokens`` takes the tokens of texts
and stems the distinct ones of a batch of texts.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from termlode.functions.stem_portuguese import stem_portuguese

_VOWELS = frozenset("aeiouy")
_DOUBLES = frozenset(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"))
# Fixed values of the published algorithm.
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_AFTER_PLURAL = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
_STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al",
    "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _region(word: str, start: int) -> int:
    """Where the part begins that follows the first non-vowel behind a vowel."""
    for i in range(start + 1, len(word)):
        if word[i] not in _VOWELS and word[i - 1] in _VOWELS:
            return i + 1
    return len(word)


def _has_vowel(part: str) -> bool:
    return any(c in _VOWELS for c in part)


def _ends_short(word: str) -> bool:
    """Whether the word ends with a short syllable."""
    if len(word) == 2:
        return word[0] in _VOWELS and word[1] not in _VOWELS
    return len(word) > 2 and word[-1] not in _VOWELS and word[-1] not in "wxY" and word[-2] in _VOWELS and word[-3] not in _VOWELS


def _ending(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


@lru_cache(maxsize=200_000)
def stem_english(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    word = word.removeprefix("'")
    letters = list(word)
    for i, c in enumerate(letters):
        if c == "y" and (i == 0 or letters[i - 1] in _VOWELS):
            letters[i] = "Y"
    word = "".join(letters)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    r1 = _region(word, 0) if r1 is None else r1
    r2 = _region(word, r1)

    end = _ending(word, ("'s'", "'s", "'"))
    if end:
        word = word[: -len(end)]

    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _has_vowel(word[:-2]):
        word = word[:-1]
    if word in _AFTER_PLURAL:
        return word

    end = _ending(word, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if end in ("eed", "eedly"):
        if len(word) - len(end) >= r1:
            word = word[: -len(end)] + "ee"
    elif end and _has_vowel(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word[-2:] in _DOUBLES:
            word = word[:-1]
        elif _ends_short(word) and r1 >= len(word):
            word += "e"

    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"

    end = _ending(word, _STEP2)
    if end and len(word) - len(end) >= r1:
        stem = word[: -len(end)]
        if (end != "ogi" or stem.endswith("l")) and (end != "li" or stem[-1:] in tuple("cdeghkmnrt")):
            word = stem + _STEP2[end]

    end = _ending(word, _STEP3)
    if end and len(word) - len(end) >= r1 and (end != "ative" or len(word) - len(end) >= r2):
        word = word[: -len(end)] + _STEP3[end]

    end = _ending(word, _STEP4)
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[: -len(end)].endswith(("s", "t"))):
        word = word[: -len(end)]

    last = len(word) - 1
    if word.endswith("e"):
        if last >= r2 or (last >= r1 and not _ends_short(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and last >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


STEMMERS = {"english": stem_english, "portuguese": stem_portuguese}


def stem_column(c: Column, language: str = "english") -> Column:
    stem = STEMMERS[language]

    @F.pandas_udf(StringType())
    def stems(words: pd.Series) -> pd.Series:
        return words.map(stem, na_action="ignore")

    return stems(c)


def stem_tokens(c: Column, language: str = "english") -> Column:
    """Every token of an array stemmed; NULL stays NULL."""
    stem = STEMMERS[language]

    @F.arrow_udf(ArrayType(StringType()))
    def stems(lists: pa.Array) -> pa.Array:
        words = lists.flatten().dictionary_encode()
        found = pa.array([None if w is None else stem(w) for w in words.dictionary.to_pylist()], pa.string()).take(words.indices)
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        edges = np.r_[0, np.cumsum(sizes)].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(edges), found, mask=lists.is_null())

    return stems(c)
