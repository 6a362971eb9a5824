"""Text normalisation and tokenising as column expressions.

Every function takes a Column and gives a Column; NULL stays NULL.  All but :func:`remove_accents` are JVM expressions, so ``clean_text``
is a single projection inside whole-stage codegen.  Alone, a step works on Unicode text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_BLANK = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
_LETTER, _DIGIT, _WORD = r"[\p{L}\p{Nl}\p{No}]", r"\p{Nd}", r"[\p{L}\p{N}_]"
# Characters that become a space.
SYMBOLS = '#:"()[]{}~=_|;<>*$`\\'
ENDS = "?!/"


def _collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, _BLANK, " "))


def _lonely(c: Column, mark: str, neighbour: str) -> Column:
    """A space for each run of ``mark`` unless it is a single one between two neighbours."""
    return F.regexp_replace(c, rf"{mark}{{2,}}|(?<!{neighbour}){mark}|{mark}(?!{neighbour})", " ")


def _spaces(c: Column, characters: str) -> Column:
    return F.translate(c, characters, " " * len(characters))


@lru_cache(maxsize=1)
def _ascii_bases() -> tuple[str, str]:
    """Accented characters and the ASCII character that is left without their marks."""
    source, target = [], []
    for code in range(0x80, 0x30000):
        ch = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFD", ch) if unicodedata.category(x) != "Mn")
        if len(base) == 1 and base.isascii():
            source.append(ch)
            target.append(base)
    return "".join(source), "".join(target)


@F.pandas_udf(StringType())
def _strip_marks(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"), na_action="ignore")


def lower(c: Column) -> Column:
    return F.lower(c)


def remove_accents(c: Column) -> Column:
    """Canonical decomposition without combining marks.  ASCII text never leaves the JVM."""
    return F.coalesce(_strip_marks(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def accents_to_ascii(c: Column) -> Column:
    """Accents off and whatever is not ASCII then removed, without leaving the JVM.  ASCII text is passed through."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), remove_non_ascii(F.translate(c, *_ascii_bases()))).otherwise(c)


def remove_non_ascii(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x00-\x7F]", "")


def unescape_quotes(c: Column) -> Column:
    return F.replace(c, F.lit("\\'"), F.lit("'"))


def clean_quotes(c: Column) -> Column:
    """Apostrophes stay between two letters only."""
    return _collapse(_lonely(c, "'", _LETTER))


def clean_commas(c: Column) -> Column:
    """Commas stay between two digits only."""
    return _collapse(_lonely(c, ",", _DIGIT))


def clean_dashes(c: Column) -> Column:
    """A dash stays between two word characters only."""
    return _collapse(_lonely(c, "-", _WORD))


def clean_dots(c: Column) -> Column:
    """A dot stays between two word characters only."""
    return _collapse(_lonely(c, r"\.", _WORD))


def clean_symbols(c: Column) -> Column:
    return _collapse(_spaces(c, SYMBOLS))


def remove_question_exclamation(c: Column) -> Column:
    return _collapse(_spaces(c, ENDS))


def remove_apostrophe_s(c: Column) -> Column:
    """``'s`` before a space becomes a space; at the end of a text it stays."""
    return _collapse(F.replace(c, F.lit("'s "), F.lit(" ")))


# Whatever becomes a space in a text that is lower-case ASCII: blanks, symbols, and marks that lack a neighbour they need.  The neighbours are
# letters, digits and word characters, which no step changes, so the order of the steps does not matter and one pass does them all.
_TO_SPACE = (
    "(?:[\\s\\x1c-\\x1f" + "".join("\\" + ch for ch in SYMBOLS + ENDS) + "]|(?<![a-z])'|'(?![a-z])|(?<![0-9]),|,(?![0-9])|(?<!\\w)[-.]|[-.](?!\\w))+"
)


def clean_text(c: Column) -> Column:
    """All eleven steps, as one projection with three passes over the text once its accents are off."""
    t = F.trim(F.regexp_replace(unescape_quotes(accents_to_ascii(lower(c))), _TO_SPACE, " "))
    return F.replace(t, F.lit("'s "), F.lit(" "))


def printable_ascii(c: Column) -> Column:
    """Accents off, then every character outside space..tilde removed: line ends too, which joins the words beside them."""
    return F.regexp_replace(F.translate(c, *_ascii_bases()), r"[^\x20-\x7E]+", "")


def printable_lower_quotes(c: Column) -> Column:
    return clean_quotes(printable_ascii(lower(c)))


def tokenize_blanks(c: Column) -> Column:
    """Tokens between spaces, tabs, line feeds and carriage returns; no empty ones; NULL for NULL."""
    return F.array_remove(F.split(c, r"[ \t\n\r]+"), "")


def tokenize_separators(c: Column, separators: Iterable[str]) -> Column:
    """Tokens between any of the separators, in lower case; no empty ones.  Tabs and line ends are no separators unless named."""
    either = "|".join("\\Q" + s + "\\E" for s in separators)
    return F.transform(F.array_remove(F.split(c, either), ""), F.lower)


def filter_tokens(tokens: Column, stopwords: Iterable[str], least_bytes: int = 0) -> Column:
    """Without exact, case-sensitive stop words and without tokens of fewer bytes than ``least_bytes``."""
    words = sorted(stopwords)
    return F.filter(tokens, lambda t: (~t.isin(words) if words else F.lit(True)) & (F.octet_length(t) >= least_bytes))


def snippet(c: Column, length: int = 100) -> Column:
    """The text, or its first ``length`` characters and an ellipsis."""
    return F.when(F.length(c) > length, F.concat(F.substring(c, 1, length), F.lit("..."))).otherwise(c)
