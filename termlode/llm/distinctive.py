"""How distinctive a term is for a record (problem 4): hypergeometric enrichment.

A record of L words, f of them the term, is seen as L draws from the collection's T words, K of them the term.  The exact probability of
drawing f or more is the upper tail of the hypergeometric distribution, summed from log-gamma terms in vectorised numpy; ``score`` is
its negative decimal logarithm and ``q_score`` its false-discovery-adjusted form (Benjamini-Hochberg over the terms of the record).  No
logarithm of T! is ever formed: quotients of factorials are worked out as such, so the score keeps its digits for any T.  The classical
weight ``(1 + log2 f) * log2(N / n)`` comes from the same statistics.

Collection statistics come from :mod:`termlode.llm.frequencies`.  They meet the records in two ways.  Terms that make up at least one part
in ``HEAVY_PARTS`` of all words - at most ``HEAVY_PARTS`` terms, whatever the collection's size - are looked up where the record is read;
all other terms are joined by shuffle, and none of them can make a hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termlode.llm.frequencies import count_terms
from termlode.llm.words import records, words_of
from termlode.plans.scratch import cut_lineage

HEAVY_PARTS = 20_000
_SMALL = 4096
_TABLE = np.concatenate([[0.0, 0.0], np.cumsum(np.log(np.arange(2, _SMALL, dtype=np.float64)))])
FOUND = "rec_id bigint, term string, f bigint, length bigint, n bigint, held bigint"
_NAMES = [c.split()[0] for c in FOUND.split(", ")]


def _series(y: np.ndarray) -> np.ndarray:
    """What Stirling's formula lacks of log(y!), for y >= 4096."""
    return 1 / (12 * y) - 1 / (360 * y**3)


def log_factorial(x: np.ndarray) -> np.ndarray:
    """log(x!) for whole x >= 0: a table below 4096, Stirling's series above (error below 1e-13 relative)."""
    x = np.asarray(x, dtype=np.float64)
    small = x < _SMALL
    y = np.where(small, float(_SMALL), x)
    return np.where(small, _TABLE[np.where(small, x, 0).astype(np.int64)], (y + 0.5) * np.log(y) - y + 0.9189385332046727 + _series(y))


def log_falling(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """log(x! / (x - m)!) without either factorial where x is large: its error follows m and not x."""
    x, m = np.broadcast_arrays(np.asarray(x, dtype=np.float64), np.asarray(m, dtype=np.float64))
    low = x - m
    near = low >= _SMALL
    a, b = np.where(near, x, 2.0 * _SMALL), np.where(near, low, 2.0 * _SMALL - 1)
    far = m * np.log(b) - (a + 0.5) * np.log1p(-(a - b) / a) - (a - b) + _series(a) - _series(b)
    return np.where(near, far, log_factorial(x) - log_factorial(np.maximum(low, 0)))


def _log_falling_ratio(total: np.ndarray, held: np.ndarray, m: np.ndarray) -> np.ndarray:
    """log of the product of (total - held - i) / (total - i) for i < m."""
    total, held, m = np.broadcast_arrays(*(np.asarray(x, dtype=np.float64) for x in (total, held, m)))
    low = total - held - m
    near = low >= _SMALL
    t, k, d = np.where(near, total, 4.0 * _SMALL), np.where(near, held, 1.0), np.where(near, m, 1.0)
    r = t - k
    far = d * np.log1p(-k / (t - d)) - (r + 0.5) * np.log1p(-d / r) + (t + 0.5) * np.log1p(-d / t) + _series(r) - _series(r - d) - _series(t) + _series(t - d)
    return np.where(near, far, log_falling(total - held, m) - log_falling(total, m))


def enrichment(f: np.ndarray, length: np.ndarray, held: np.ndarray, total: float) -> np.ndarray:
    """``-log10 P(X >= f)``, X hypergeometric: ``length`` draws from ``total`` words of which ``held`` are the term.

    f counts at most ``min(held, length)``; a term the collection lacks scores 0.
    """
    held = np.asarray(held, dtype=np.float64)
    length = np.minimum(np.asarray(length, dtype=np.float64), total)
    f = np.minimum(np.minimum(np.asarray(f, dtype=np.float64), held), length)
    f = np.maximum(f, np.maximum(0.0, length - (total - held)))
    # P(f) = K!/(K-f)! / f! * L!/(L-f)! * prod over i < L-f of (T-K-i)/(T-i) / prod over L-f <= i < L of (T-i)
    log_p = log_falling(held, f) - log_factorial(f) + log_falling(length, f) + _log_falling_ratio(total, held, length - f) - log_falling(total - length + f, f)
    top = np.minimum(held, length)
    tail, term, k = np.ones_like(f), np.ones_like(f), f.copy()
    live = np.flatnonzero(k < top)
    while live.size:
        kk, h, ln = k[live], held[live], length[live]
        ratio = (h - kk) * (ln - kk) / ((kk + 1) * np.maximum(total - h - ln + kk + 1, 1e-300))
        term[live] *= ratio
        tail[live] += term[live]
        k[live] += 1
        # Beyond the mode the ratios only fall; stop where a term no longer changes the sum.
        live = live[(k[live] < top[live]) & ((ratio >= 1) | (term[live] > 1e-17 * tail[live]))]
    score = -(log_p + np.log(tail)) / np.log(10)
    return np.where((held > 0) & (f > 0), np.maximum(score, 0.0), 0.0)


def term_weight(f: np.ndarray, n: np.ndarray, n_records: float) -> np.ndarray:
    """``(1 + log2 f) * log2(N / n)`` rounded to 6 places, 0 for a term the collection lacks."""
    f, n = np.asarray(f, dtype=np.float64), np.asarray(n, dtype=np.float64)
    with np.errstate(divide="ignore"):
        return np.round((1 + np.log2(f)) * np.where(n > 0, np.log2(n_records / np.maximum(n, 1)), 0.0), 6)


def _terms(stats, n_records: float, top: int | None, slice_words: int = 100_000):
    """A row for each record and distinct term; n and held are NULL where the term is not among the heavy ones."""

    def out(names, texts):
        code, n, held = stats.value
        own = dict(code)  # grows by the other terms of this slice
        heavy = len(code)
        words, owner, size = [], [], []
        for found in texts:
            words += [own.setdefault(w, len(own)) for w in found]
            size.append(len(found))
        size = np.array(size, dtype=np.int64)
        owner = np.repeat(np.arange(len(texts)), size)
        pair, f = np.unique(owner * len(own) + np.array(words, dtype=np.int64), return_counts=True)
        owner, word = np.divmod(pair, len(own))
        terms = np.array(list(own), dtype=object)
        if top is not None:
            # Of a record's heavy terms only its best can be among the record's best.
            near = np.flatnonzero(word < heavy)
            w = term_weight(f[near], n[word[near]], n_records)
            order = near[np.lexsort((word[near], -w, owner[near]))]  # heavy terms are numbered in order
            first = np.flatnonzero(np.r_[True, owner[order][1:] != owner[order][:-1]]) if len(order) else np.zeros(0, dtype=np.int64)
            rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
            keep = np.sort(np.r_[order[rank < top], np.flatnonzero(word >= heavy)])
            owner, word, f = owner[keep], word[keep], f[keep]
        light = word >= heavy
        at = np.where(light, 0, word)
        blank = np.zeros(1, dtype=np.int64)
        columns = [pa.array(np.array(names, dtype=np.int64)[owner]), pa.array(terms[word], pa.string()), pa.array(f), pa.array(size[owner])]
        columns += [pa.array((x if heavy else blank)[at], pa.int64(), mask=light) for x in (n, held)]
        return pa.RecordBatch.from_arrays(columns, names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, texts, words = [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = words_of(text)
                if found:
                    names.append(key)
                    texts.append(found)
                    words += len(found)
                if words >= slice_words:
                    yield out(names, texts)
                    names, texts, words = [], [], 0
        if texts:
            yield out(names, texts)

    return run


def _measure(total: float, n_records: float, measures: tuple[str, ...]):
    """The rows with the measures asked for in place of ``held``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, length, n, held = (b.column(k).to_numpy(zero_copy_only=False) for k in range(2, 6))
            made = {"score": lambda f=f, length=length, held=held: enrichment(f, length, held, total), "weight": lambda f=f, n=n: term_weight(f, n, n_records)}
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *(pa.array(made[m]()) for m in measures)], names=[*_NAMES[:5], *measures])

    return run


class TermWeights:
    """Statistics of one collection, ready to score any records against it."""

    def __init__(self, collection: DataFrame, key: str, text: str, **radix) -> None:
        self.spark = collection.sparkSession
        self.terms = count_terms(collection, key, text, **radix)
        totals = self.terms.where("term = ''").collect()
        self.total, self.n_records = (float(totals[0]["occurrences"]), float(totals[0]["records"])) if totals else (0.0, 0.0)
        self.floor = max(1.0, self.total / HEAVY_PARTS)
        heavy = sorted(tuple(r) for r in self.terms.where((F.col("term") != "") & (F.col("occurrences") >= self.floor)).select("term", "records", "occurrences").collect())  # at most HEAVY_PARTS rows
        self.heavy = self.spark.sparkContext.broadcast(({r[0]: k for k, r in enumerate(heavy)}, np.array([r[1] for r in heavy], dtype=np.int64), np.array([r[2] for r in heavy], dtype=np.int64)))

    def score(self, df: DataFrame, key: str, text: str, measures: tuple[str, ...] = ("score", "weight"), top: int | None = None) -> DataFrame:
        """``(rec_id, term, f, length, n)`` and the ``measures``: a row for each record and distinct term.

        ``top`` leaves out those heavy terms of a record that can't be among its ``top`` best by weight.  Repeated rows of a key count
        once; NULL, empty and wordless texts give no row; terms that the collection lacks have n, score and weight 0.
        """
        # A text is taken apart once; its heavy and its other terms part where they are read back.
        found = cut_lineage(records(df, key, text).where("text IS NOT NULL").mapInArrow(_terms(self.heavy, self.n_records, top), FOUND), "terms_of")
        light = self.terms.where((F.col("term") != "") & (F.col("occurrences") < self.floor)).select("term", F.col("records").alias("n"), F.col("occurrences").alias("held"))
        far = found.where("n IS NULL").select(*_NAMES[:4]).join(light, "term", "left").na.fill(0, ["n", "held"]).select(*_NAMES)
        shape = ", ".join([*FOUND.split(", ")[:5], *(f"{m} double" for m in measures)])
        return found.where("n IS NOT NULL").unionByName(far).mapInArrow(_measure(self.total, self.n_records, measures), shape)

    def adjusted(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """As :meth:`score`, with ``q_score``: the negative decimal logarithm of the Benjamini-Hochberg-adjusted probability."""
        by = Window.partitionBy("rec_id").orderBy(F.desc("score"), "term")
        ranked = self.score(df, key, text, ("score",)).withColumn("rank", F.row_number().over(by)).withColumn("m", F.count("*").over(Window.partitionBy("rec_id")))
        raised = ranked.withColumn("raised", F.col("score") - F.log10(F.col("m") / F.col("rank")))
        after = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        return raised.withColumn("q_score", F.greatest(F.max("raised").over(after), F.lit(0.0))).drop("raised", "rank", "m")


def top_terms(scored: DataFrame, by: str, top: int) -> DataFrame:
    """The up to ``top`` terms of each record with the highest positive ``by``, equal ones by term in code-point order."""
    order = Window.partitionBy("rec_id").orderBy(F.desc(by), "term")
    return scored.where(F.col(by) > 0).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
