"""Duplicates hidden by formatting (problem 3): skip-and-fold rolling hashes with a two-pointer proof.

Texts run through a lookup table that folds letters and digits to lower case and skips everything else, straight into polynomial hashes modulo
two primes; the start of a word is part of its first symbol.  Look-alike characters of a dirty text are mapped while it passes; neither that
form nor any canonical string is kept.  A text has a hash of all its words in order; a field record (it holds one of ``; | : =``) also has one of its set of fields, where the rank within
the field, not the field's place, is the power, and fields are added up.

Equal strings, told by 128 bits, are one from the start, however many rows hold them.  Strings whose hashes collide are compared with their
group's first one by two pointers that skip what the table skips.  Those that fail form a group of their own and are compared again, until none
fails.  Texts that share words-in-order or fields belong together, and so do texts
that a third one links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from termlode.llm.lookalikes import fold_lookalikes
from termlode.llm.words import records, sized
from termlode.plans.scratch import cut_lineage

P1, P2 = np.uint64(2147483647), np.uint64(2147483629)
BASE1, BASE2 = np.uint64(1_000_003), np.uint64(7_368_787)
START, VALUE = np.uint64(1 << 21), np.uint64(1 << 22)
SEPARATORS, JOINERS = ";|\r\n", ":="
HASHED = "rec_id bigint, h1 bigint, h2 bigint, words bigint, size bigint, fields bigint"


_TABLE = np.zeros(0x110000, dtype=np.uint32)
_FILLED = np.zeros(0x1100, dtype=bool)


def fold_units(units: np.ndarray) -> np.ndarray:
    """For each code point its lower-case letter or digit, or 0 to skip it.  The table is filled by the blocks that texts use."""
    for block in np.flatnonzero(np.bincount(units >> 8, minlength=1)).tolist():
        if not _FILLED[block]:
            for code in range(block << 8, (block + 1) << 8):
                ch = chr(code)
                if ch.isalnum():
                    _TABLE[code] = ord(ch.lower()[0])
            _FILLED[block] = True
    return _TABLE[units]


def folded_text(text: str) -> list[int]:
    return fold_units(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)).tolist()


def _powers(n: int, base: np.uint64, prime: np.uint64) -> np.ndarray:
    out = np.ones(max(n, 1), dtype=np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        top = out[done - 1] * base % prime
        out[done : done + step] = out[:step] * top % prime
        done += step
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _poly(symbols: np.ndarray, segment: np.ndarray, segments: int) -> np.ndarray:
    """A 62-bit hash for each of the segments (numbers in order, with gaps allowed) of the symbol stream."""
    first = np.searchsorted(segment, np.arange(segments))
    rank = np.arange(len(symbols)) - first[segment] if len(symbols) else np.zeros(0, dtype=np.int64)
    used = np.unique(segment)
    out = np.zeros(segments, dtype=np.uint64)
    if len(used):
        n, starts = int(rank.max()) + 1, first[used]
        h1 = np.add.reduceat(symbols * _powers(n, BASE1, P1)[rank] % P1, starts) % P1
        h2 = np.add.reduceat(symbols * _powers(n, BASE2, P2)[rank] % P2, starts) % P2
        out[used] = (h1 << np.uint64(31)) | h2
    return out


def hash_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(words, size, fields)`` of consistent forms: the hash of the words in order, the number of letters, and the hash of the set of
    fields, 0 where the text is no field record."""
    n = len(texts)
    units = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    text = np.repeat(np.arange(n), np.fromiter(map(len, texts), dtype=np.int64, count=n))
    folded = fold_units(units)
    keep = folded > 0
    begins = np.ones(len(units), dtype=bool)
    begins[1:] = ~keep[:-1] | (text[1:] != text[:-1])
    split = np.isin(units, [ord(c) for c in SEPARATORS])
    join = np.isin(units, [ord(c) for c in JOINERS])
    symbols = folded[keep].astype(np.uint64) | np.where(begins[keep], START, np.uint64(0))
    owner = text[keep]
    words = _poly(symbols, owner, n)
    size = np.bincount(owner, minlength=n)
    fields = np.zeros(n, dtype=np.uint64)
    is_record = np.zeros(n, dtype=bool)
    is_record[text[join | np.isin(units, [ord(c) for c in ";|"])]] = True
    if is_record.any():
        edge = np.zeros(len(units), dtype=bool)
        edge[1:] = text[1:] != text[:-1]
        field = np.cumsum(split | edge)
        # A value begins behind the first joiner of its field.
        joined = np.cumsum(join)
        at_field = np.searchsorted(field, np.arange(int(field[-1]) + 1)) if len(field) else np.zeros(0, dtype=np.int64)
        before = np.where(at_field > 0, joined[np.maximum(at_field - 1, 0)], 0)
        in_value = joined > before[field]
        mine = keep & is_record[text]
        kept_field = field[mine]
        sym = folded[mine].astype(np.uint64) | np.where(begins[mine], START, np.uint64(0)) | np.where(in_value[mine], VALUE, np.uint64(0))
        present, compact = np.unique(kept_field, return_inverse=True)
        hashes = _mix(_poly(sym, compact, len(present)) + np.uint64(0x9E3779B97F4A7C15))
        of = text[mine][np.searchsorted(compact, np.arange(len(present)))]
        order = np.lexsort((hashes, of))
        of, hashes = of[order], hashes[order]
        new = np.ones(len(of), dtype=bool)
        new[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
        np.add.at(fields, of[new], hashes[new])
        fields[is_record & (fields == 0) & (size > 0)] = np.uint64(1)
    return words, size, fields


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words, size, fields = hash_texts([fold_lookalikes(x) for x in b.column(3).to_pylist()])
        some = size > 0
        keys = [pa.array(b.column(k).to_numpy(zero_copy_only=False)[some], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(words[some].view(np.int64)), pa.array(size[some]), pa.array(fields[some].view(np.int64))], names=[c.split()[0] for c in HASHED.split(", ")])


def same_words(a: str, b: str) -> bool:
    """Two-pointer comparison: whether both hold the same words in the same order, skipping all else."""
    if a == b:
        return True
    x, y = folded_text(a), folded_text(b)
    i = j = 0
    n, m = len(x), len(y)
    inside = False
    while True:
        gap_a = gap_b = False
        while i < n and not x[i]:
            gap_a, i = True, i + 1
        while j < m and not y[j]:
            gap_b, j = True, j + 1
        if i == n or j == m:
            return i == n and j == m
        if (inside and gap_a != gap_b) or x[i] != y[j]:
            return False
        inside = True
        i, j = i + 1, j + 1


def _spans(text: str) -> dict[tuple[int, int], list[tuple[str, str]]]:
    """Label and value of each field that has a word, as slices of the text, by the sums of their folded letters."""
    out: dict[tuple[int, int], list[tuple[str, str]]] = {}
    start = 0
    for k in range(len(text) + 1):
        if k == len(text) or text[k] in SEPARATORS:
            part = text[start:k]
            at = min((p for p in map(part.find, JOINERS) if p >= 0), default=len(part))
            label, value = part[:at], part[at + 1 :]
            key = sum(folded_text(label)), sum(folded_text(value))
            if any(key):
                out.setdefault(key, []).append((label, value))
            start = k + 1
    return out


def is_record(text: str) -> bool:
    return any(c in text for c in ";|:=")


def same_fields(a: str, b: str) -> bool:
    """Whether two field records hold the same set of fields: each field of either is proved against one of the other by two pointers."""
    if a == b:
        return True
    x, y = _spans(a), _spans(b)

    def held(own: list, others: list) -> bool:
        return all(any(same_words(f[0], o[0]) and same_words(f[1], o[1]) for o in others) for f in own)

    return x.keys() == y.keys() and all(held(x[k], y[k]) and held(y[k], x[k]) for k in x)


@F.pandas_udf(BooleanType())
def _prove_words(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([same_words(fold_lookalikes(x), fold_lookalikes(y)) for x, y in zip(a, b, strict=True)], dtype=bool)


@F.pandas_udf(BooleanType())
def _prove_fields(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([same_fields(fold_lookalikes(x), fold_lookalikes(y)) for x, y in zip(a, b, strict=True)], dtype=bool)


def _proved(strings: DataFrame, texts: DataFrame, keys: list[str], prove, name: str) -> DataFrame:
    """``(rec_id, node)``: strings of hash groups of two or more, with the least key of the proved group; strings alone give none."""
    open_rows = strings.select("rec_id", *keys, F.lit(0).alias("round"))
    done: list[DataFrame] = []
    while True:
        leads = open_rows.groupBy(*keys, "round").agg(F.min("rec_id").alias("node"), F.count("*").alias("n")).where("n > 1").drop("n")
        members = cut_lineage(open_rows.join(leads, [*keys, "round"]).select("rec_id", *keys, "round", "node"), f"{name}_open")
        shown_texts = texts.join(sized(members.select("rec_id")), "rec_id", "left_semi")
        lead_texts = shown_texts.select(F.col("rec_id").alias("node"), F.col("text").alias("lead_text"))
        # The lead's text meets each of its members, never members each other.
        shown = members.join(shown_texts, "rec_id").join(lead_texts, "node").select("rec_id", *keys, "round", "node", (F.coalesce(prove("text", "lead_text"), F.lit(False))).alias("same"))
        shown = cut_lineage(shown, name)
        done.append(shown.where("same").select("rec_id", "node"))
        open_rows = shown.where("NOT same").select("rec_id", *keys, (F.col("round") + 1).alias("round"))
        if not open_rows.limit(1).count():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def formatting_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(rec_id, keep_id)`` for every record that has a duplicate: ``keep_id`` is the least key of its class.

    Repeated rows of a key count once; NULL, empty and wordless texts are never duplicates; NULL keys give no row.  A class may be as
    large as it likes: its strings meet only the class's first one, and copies of a string meet nothing.
    """
    texts = records(df, key, text).where("text IS NOT NULL")
    hashed = texts.select("rec_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text").mapInArrow(_hash_batches, HASHED)
    hashed = cut_lineage(hashed, "hashes")
    strings = hashed.groupBy("h1", "h2").agg(F.min("rec_id").alias("rec_id"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("words", "size", "fields")])
    strings = cut_lineage(strings, "strings")
    by_words = _proved(strings, texts, ["words", "size"], _prove_words, "words")
    by_fields = _proved(strings.where("fields != 0"), texts, ["fields"], _prove_fields, "fields")
    # Two kinds of links: a string's words node and its fields node.  Least labels run back and forth until nothing changes.
    links = cut_lineage(by_words.select("rec_id", F.col("node").alias("w")).join(by_fields.select("rec_id", F.col("node").alias("f")), "rec_id", "full"), "links")
    labels = links.select("rec_id", "w", "f", F.least("w", "f").alias("label"))
    both = links.where("w IS NOT NULL AND f IS NOT NULL AND w != f").limit(1).count()
    while both:
        low_w = labels.where("w IS NOT NULL").groupBy("w").agg(F.min("label").alias("lw"))
        low_f = labels.where("f IS NOT NULL").groupBy("f").agg(F.min("label").alias("lf"))
        moved = labels.join(low_w, "w", "left").join(low_f, "f", "left").select("rec_id", "w", "f", F.least("label", "lw", "lf").alias("label"), (F.least("label", "lw", "lf") < F.col("label")).alias("moved"))
        moved = cut_lineage(moved, "labels")
        labels = moved.drop("moved")
        both = moved.where("moved").limit(1).count()
    kept = strings.select("rec_id", "h1", "h2", "copies").join(labels.select("rec_id", "label"), "rec_id", "left").where("copies > 1 OR label IS NOT NULL")
    kept = cut_lineage(kept.select("h1", "h2", F.coalesce("label", "rec_id").alias("keep_id")), "kept")
    return hashed.select("rec_id", "h1", "h2").join(sized(kept), ["h1", "h2"]).select("rec_id", "keep_id")


def collapse_formatting(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(rec_id, copies)``: one record for each class, the least key, with the number of its copies, itself included; records without a
    duplicate have 1.  Records whose text has no word are kept, each for itself."""
    classes = formatting_classes(df, key, text)
    counts = classes.groupBy("keep_id").agg(F.count("*").alias("copies"))
    lost = classes.where("rec_id != keep_id").select("rec_id")
    kept = records(df, key, text).select("rec_id").join(lost, "rec_id", "left_anti")
    return kept.join(counts, kept["rec_id"] == counts["keep_id"], "left").select("rec_id", F.coalesce("copies", F.lit(1)).alias("copies"))
