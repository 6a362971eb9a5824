"""One consistent form for text that looks the same (problem 1).

``map_lookalikes`` is the per-text mapping, ``fold_lookalikes`` the consistent form, which is the mapping composed; ``consistent_text`` is its
column form: text that already is in the form never leaves the JVM (the Arrow UDF receives NULL for it), so only the dirty share of a corpus
pays for Python.  ``Lookalikes`` is the operator: look-alike-mapped values are grouped in SQL under the accent- and case-sensitive ICU
collation ``UNICODE``, the least form of each class becomes its canonical member and is joined back.  The mapping leaves accents as they are
written, as one character or as two: which sequences of letters and accents are the same is decided by the collation alone.

What the form is, in this order:

* characters without an own appearance (general category Cf, variation selectors, the combining grapheme joiner, C0/C1 controls other
  than tab, line feed and carriage return) vanish;
* full-width and half-width forms become their plain form, the presentation ligatures (U+FB00..U+FB06) their letters;
* every other blank (category Zs) becomes one space each: the number of blanks stays; tab, CR and LF stay as they are;
* hyphens that print as ``-`` become ``-``;
* in each word, look-alike letters of other scripts become Latin, unless the word holds a letter that exists in its own script only:
  then it is a genuine word and its ambiguous letters become that script's;
* the result is NFC.

NULL stays NULL, empty stays empty.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from termlode.plans.scratch import cut_lineage

# Letters of other scripts that print like a Latin letter.
CYRILLIC = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Ү": "Y", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c",
    "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v",
}
GREEK = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ν": "v", "ο": "o", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
}
ARMENIAN = {"Տ": "S", "Օ": "O", "հ": "h", "ո": "n", "ս": "u", "օ": "o", "ց": "g", "զ": "q", "յ": "j", "Լ": "L"}
OTHER = {"ɡ": "g", "ɑ": "a", "ⅼ": "l", "ꓲ": "I"}
SCRIPTS = {"CYRILLIC": CYRILLIC, "GREEK": GREEK, "ARMENIAN": ARMENIAN}
TO_LATIN = str.maketrans(CYRILLIC | GREEK | ARMENIAN | OTHER)
#: Latin letter -> the script's letter, for genuine words into which a Latin or third-script letter has slipped.
TO_SCRIPT = {name: str.maketrans({latin: own for own, latin in reversed(pairs.items())}) for name, pairs in SCRIPTS.items()}
HYPHENS = "‐‑﹣－"
LIGATURES = range(0xFB00, 0xFB07)
#: Characters outside those that the form leaves as they are: ASCII, composed Latin letters, Latin-1 signs, quotation marks, dashes, ellipsis.
#: A text that holds none of them already is in the form and never leaves the JVM.
DIRTY = r"[^\t\n\r\x20-\x7E\u00A1-\u00AC\u00AE-\u024F\u1E00-\u1EFF\u2013\u2014\u2018\u2019\u201C-\u201E\u2026]"
_DIRTY = re.compile(DIRTY)
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f])*")


class _Glyphs(dict):
    """str.translate table that works out each character's plain form the first time it is met."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        category = unicodedata.category(ch)
        kind = unicodedata.decomposition(ch)
        if ch in "\t\n\r":
            plain = ch
        elif category in ("Cf", "Cc") or code == 0x034F or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or code in (0x115F, 0x1160, 0x3164, 0xFFA0):
            plain = ""
        elif ch in HYPHENS:
            plain = "-"
        elif category == "Zs":
            plain = " "
        elif kind.startswith(("<wide>", "<narrow>")) or code in LIGATURES:
            plain = unicodedata.normalize("NFKC", ch)
        else:
            plain = ch
        self[code] = plain
        return plain


_GLYPHS = _Glyphs()


@lru_cache(maxsize=4096)
def _script(ch: str) -> str:
    return unicodedata.name(ch, "").partition(" ")[0]


def _word(match: re.Match) -> str:
    word = match.group()
    if word.isascii():
        return word
    latin = word.translate(TO_LATIN)
    own = {_script(ch) for ch in latin} & SCRIPTS.keys()  # letters that stay foreign
    if not own:
        return latin
    return latin.translate(TO_SCRIPT[own.pop()]) if len(own) == 1 else word


def map_lookalikes(text: str | None) -> str | None:
    """Look-alikes mapped; accents of a text that is changed are left as characters of their own."""
    if text is None or not _DIRTY.search(text):
        return text
    plain = text.translate(_GLYPHS)
    return plain if plain.isascii() else _WORD.sub(_word, unicodedata.normalize("NFD", plain))


def fold_lookalikes(text: str | None) -> str | None:
    """The consistent form of one text."""
    mapped = map_lookalikes(text)
    return mapped if mapped is None or mapped.isascii() else unicodedata.normalize("NFC", mapped)


@F.pandas_udf(StringType())
def _fold(texts: pd.Series) -> pd.Series:
    return pd.Series([fold_lookalikes(x) for x in texts], dtype=object)


def consistent_text(text: Column) -> Column:
    """Column form of :func:`fold_lookalikes`; text in the form is passed through inside the JVM."""
    dirty = F.when(text.rlike(DIRTY), text)
    return F.coalesce(_fold(dirty), text)


@F.pandas_udf(StringType())
def _map(texts: pd.Series) -> pd.Series:
    return pd.Series([map_lookalikes(x) for x in texts], dtype=object)


@lru_cache(maxsize=1)
def _bases() -> tuple[str, str]:
    """Composed characters of text that the mapping passes through, and what is left of them without accents."""
    pairs = []
    for code in [*range(0xA1, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn")
        if base != chr(code) and len(base) == 1:
            pairs.append((chr(code), base))
    return "".join(x for x, _ in pairs), "".join(x for _, x in pairs)


def _skeleton(mapped: Column) -> Column:
    """The mapped text without accents: the same for all texts that the collation takes for equal, and for more."""
    return F.when(mapped.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(mapped, *_bases()), r"\p{Mn}+", "")).otherwise(mapped)


class Lookalikes:
    """Operator of problem 1 over the texts of one table.

    Texts whose mapped forms are equal under the collation ``UNICODE`` (tertiary strength: letters, case, accents, punctuation, blanks and line
    ends count; canonically equivalent sequences do not differ) are one class.  Texts without a letter or digit are in no class; NULL keys and
    NULL texts give no row; repeated rows of a key count once; an empty table gives no rows.

    Work: texts become two 64-bit hashes and one of their skeleton; only texts whose skeleton belongs to different strings meet the collation,
    each string once, however many keys have it.  Texts themselves are not shuffled, but for those strings.
    """

    def __init__(self, df: DataFrame, key: str, text: str) -> None:
        from termlode.llm.words import HAS_WORD, records, sized

        self.spark: SparkSession = df.sparkSession
        self.texts = records(df, key, text).where("text IS NOT NULL")
        mapped = self.texts.withColumn("mapped", F.coalesce(_map(F.when(F.col("text").rlike(DIRTY), F.col("text"))), F.col("text"))).where(F.col("mapped").rlike(HAS_WORD))
        rows = mapped.select("rec_id", F.xxhash64(_skeleton(F.col("mapped"))).alias("face"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
        self.rows = cut_lineage(rows, "faces")
        several = self.rows.groupBy("face").agg(*[f(h).alias(f"{n}{h}") for h in ("h1", "h2") for n, f in (("least", F.min), ("most", F.max))])
        self.several = sized(cut_lineage(several.where("leasth1 != mosth1 OR leasth2 != mosth2").select("face"), "several"))
        self.open = self.rows.join(self.several, "face", "left_semi")
        strings = cut_lineage(self.open.groupBy("face", "h1", "h2").agg(F.min("rec_id").alias("variant")), "strings")
        held = self.texts.join(sized(strings).withColumnRenamed("variant", "rec_id"), "rec_id")
        held = held.select("face", "h1", "h2", F.col("rec_id").alias("variant"), F.coalesce(_map(F.when(F.col("text").rlike(DIRTY), F.col("text"))), F.col("text")).alias("mapped"), consistent_text(F.col("text")).alias("form"))
        looks = self.spark.sql(
            """
            SELECT face, h1, h2, variant, min(form) OVER look AS canonical, min(variant) OVER look AS class_id, count(*) OVER look - 1 AS links
            FROM {held} WINDOW look AS (PARTITION BY face, mapped COLLATE UNICODE)
            """,
            held=held.repartition("face"),
        )
        self.looks = cut_lineage(looks, "looks")

    def classes(self) -> DataFrame:
        """``(rec_id, canonical, class_id, links)``: the class's least form in code-point order, its least key, and to how many other strings
        the text's own looks the same."""
        mixed = self.open.join(self.looks, ["face", "h1", "h2"]).select("rec_id", "canonical", "class_id", "links")
        alone = self.rows.join(self.several, "face", "left_anti").select("rec_id", "face")
        least = alone.groupBy("face").agg(F.min("rec_id").alias("class_id"))
        alone = alone.join(least, "face").select("rec_id", F.lit(None).cast("string").alias("canonical"), "class_id", F.lit(0).cast("bigint").alias("links"))
        found = self.texts.join(mixed.unionByName(alone), "rec_id")
        return found.select("rec_id", F.coalesce("canonical", consistent_text(F.col("text"))).alias("canonical"), "class_id", "links")

    def pairs(self) -> DataFrame:
        """``(key_a, key_b)``: every two keys of a class whose texts are not the same string.

        Pairs are made between the different strings of a class first and only then between the keys that carry them, so that exact copies
        of one string, however many, never meet each other; the work is that of the result.
        """
        looks = self.looks.where("links > 0")
        members = cut_lineage(self.open.join(looks, ["face", "h1", "h2"]).select("rec_id", "variant"), "members")
        return self.spark.sql(
            """
            WITH mixed AS (SELECT a.variant AS a, b.variant AS b FROM {looks} a JOIN {looks} b ON a.class_id = b.class_id AND a.variant < b.variant)
            SELECT least(x.rec_id, y.rec_id) AS key_a, greatest(x.rec_id, y.rec_id) AS key_b
            FROM mixed p JOIN {members} x ON x.variant = p.a JOIN {members} y ON y.variant = p.b
            """,
            looks=looks,
            members=members,
        )
