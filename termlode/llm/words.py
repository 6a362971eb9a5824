"""Words of the consistent form, and input shaping shared by this subpackage.

A word is a longest run of letters and digits of the consistent form, in lower case; ``_`` divides.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlode.llm.lookalikes import fold_lookalikes
from termlode.plans.scratch import cut_lineage

WORD = re.compile(r"[^\W_]+")
#: The same for the JVM's regular expressions.
HAS_WORD = r"[\p{L}\p{N}]"


def words_of(text: str | None) -> list[str]:
    """Words of a text in order; none for NULL."""
    if not text:
        return []
    form = fold_lookalikes(text)
    low = form.lower()
    # A few capitals grow a combining mark when lowered; it must not divide the word.
    return WORD.findall(low) if len(low) == len(form) else [w.lower() for w in WORD.findall(form)]


def sized(keys: DataFrame, most: int = 500_000) -> DataFrame:
    """A stored table of keys, to be broadcast if a count of its rows shows at most ``most``; else to be joined by shuffle."""
    return F.broadcast(keys) if keys.count() <= most else keys


def records(df: DataFrame, key: str, text: str, *, most_again: int = 500_000) -> DataFrame:
    """``(rec_id, text)`` with one row per key.

    Repeated rows of a key count once.  Should they differ in text, the least non-NULL text stands, so that the choice does not depend on
    the order of the rows.  Rows with a NULL key are left out: they cannot be named in a result.

    Keys that occur again are found by counting keys alone.  Up to ``most_again`` of them are broadcast, and only their rows are grouped;
    all other texts stay where they are.  Beyond that number every text is grouped by its key.
    """
    picked = df.select(F.col(f"`{key}`").alias("rec_id"), F.col(f"`{text}`").cast("string").alias("text")).where("rec_id IS NOT NULL")
    again = cut_lineage(picked.groupBy("rec_id").count().where("count > 1").select("rec_id"), "again")
    held = again.count()
    if not held:
        return picked
    if held > most_again:
        return picked.groupBy("rec_id").agg(F.min("text").alias("text"))
    keys = F.broadcast(again)  # its size has just been checked
    return picked.join(keys, "rec_id", "left_anti").unionByName(picked.join(keys, "rec_id", "left_semi").groupBy("rec_id").agg(F.min("text").alias("text")))
