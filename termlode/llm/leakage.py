"""Evaluation texts in training text (problem 8): latent semantic retrieval.

The held-out items are a stated query set (``max_items`` at most).  Their words are the vocabulary, so every model here is as large as the
items and not as the corpus.  Steps:

1. Every document is encoded once as a sequence of vocabulary numbers (-1: a word no item has) and its passages are counted for idf.
2. A randomised SVD of the TF-IDF passage matrix of the whole corpus: two passes over the encoded passages, each of which adds up
   ``A'(A X)`` for a thin matrix X, within tasks first and then by shuffle; then a Rayleigh-Ritz step on the driver, on a matrix as small as
   the vocabulary times the rank.
3. A passage's latent vector is the sum of its words' rows, added up in the order of its words.  A last coordinate, small and different for
   each word, keeps it from being zero.  Candidates are passages whose cosine with an item's passage reaches a bound.  For bounds near one,
   projections on one direction are sorted, and as two unit vectors of cosine c differ by ``sqrt(2 - 2c)`` on it at most, only a slice has to be
   looked at.  For lower bounds the items' passages lie in cells, and a cell is looked at only if its greatest possible cosine suffices.
4. Candidates are proved on the words: the longest common run, or - for paraphrases - the longest common subsequence and the answer.

Passages of the length asked for, taken at every word, lose nothing: equal passages have latent vectors that are equal bit by bit, whatever the
rank, as they come from the same additions in the same order, and a run of ten words of an item lies wholly within a run of vocabulary
words of the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlode.llm.words import words_of
from termlode.plans.scratch import cut_lineage

PASSAGE = 24


def _windows(mask: np.ndarray, width: int) -> np.ndarray:
    """Starts of the windows of ``width`` positions that are all set."""
    if len(mask) < width:
        return np.zeros(0, dtype=np.int64)
    total = np.r_[0, np.cumsum(mask)]
    return np.flatnonzero(total[width:] - total[:-width] == width)


def _slices(batch: pa.RecordBatch, most: int = 150_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A batch in parts of about ``most`` words: keys, all sequences behind each other, and where each begins (one more at the end)."""
    raw = [np.frombuffer(x, dtype=np.int32) for x in batch.column(1).to_pylist()]
    keys = batch.column(0).to_numpy()
    ends = np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64)
    at = 0
    while at < len(raw):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield keys[at:to], np.concatenate(raw[at:to]), ends[at : to + 1] - ends[at]
        at = to


def _encode(vocabulary):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for b in batches:
            keys, codes = [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = [number.get(w, -1) for w in words_of(text)]
                if found:
                    keys.append(key)
                    codes.append(np.array(found, dtype=np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(codes, pa.binary())], names=["doc_id", "codes"])

    return encode


def _passages(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vocabulary words of a batch and the passage each is in: every PASSAGE words of a document, the last one shorter."""
    at = np.arange(len(codes)) - np.repeat(ends[:-1], np.diff(ends))
    begins = np.cumsum(at % PASSAGE == 0) - 1
    known = codes >= 0
    return codes[known].astype(np.int64), begins[known]


def _count(size: int):
    """Passages that hold each word; the last row is the number of passages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size + 1, dtype=np.int64)
        for b in batches:
            for _, codes, ends in _slices(b):
                word, passage = _passages(codes, ends)
                pair = np.unique(passage * size + word)
                held[:size] += np.bincount(pair % size, minlength=size)
                held[size] += np.ceil(np.diff(ends) / PASSAGE).astype(np.int64).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(held)], names=["word", "held"])

    return count


def _gram(thin):
    """``A' (A X)`` of a task's passages, one row per word."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, x = thin.value
        weighted = (idf[:, None] * x).astype(np.float32)
        out = np.zeros(x.shape, dtype=np.float64)
        for b in batches:
            for _, codes, ends in _slices(b):
                word, passage = _passages(codes, ends)
                if not len(word):
                    continue
                new = np.r_[True, passage[1:] != passage[:-1]]
                y = np.add.reduceat(weighted[word], np.flatnonzero(new), axis=0)
                of = np.cumsum(new) - 1
                order = np.argsort(word.astype(np.int16) if len(out) < 1 << 15 else word, kind="stable")  # short numbers are sorted by radix
                word = word[order]
                start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                out[word[start]] += np.add.reduceat(y[of[order]], start, axis=0)
        out *= idf[:, None]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), *(pa.array(out[:, k]) for k in range(out.shape[1]))], names=["word", *(f"x{k}" for k in range(out.shape[1]))])

    return gram


class LeakageIndex:
    """Latent index of a set of held-out items over a corpus, ready to search that corpus.

    NULL, empty and wordless texts, of items and documents, match nothing; repeated rows change nothing; NULL keys are left out.
    """

    def __init__(self, docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, answer: str | None = None, *, rank: int = 16, oversample: int = 8, seed: int = 20, max_items: int = 100_000) -> None:
        self.spark = spark = docs.sparkSession
        picked = items.select(F.col(f"`{item_key}`").cast("bigint"), F.col(f"`{item_text}`").cast("string"), (F.col(f"`{answer}`").cast("string") if answer else F.lit(None).cast("string"))).where(F.col(f"`{item_key}`").isNotNull()).distinct().limit(max_items + 1).collect()
        if len(picked) > max_items:
            raise ValueError(f"more than {max_items} items")
        self.items = sorted((r[0], words_of(r[1]), tuple(words_of(r[2]))) for r in picked)
        vocabulary = sorted({w for _, words, _ in self.items for w in words} | {w for _, _, words in self.items for w in words})
        number = {w: k for k, w in enumerate(vocabulary)}
        self.size = len(vocabulary)
        self.item_codes = [np.array([number[w] for w in words], dtype=np.int32) for _, words, _ in self.items]
        self.answers = [np.array([number[w] for w in words], dtype=np.int32) for _, _, words in self.items]
        rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
        if not self.size:
            self.encoded, self.table = spark.createDataFrame([], "doc_id bigint, codes binary"), np.zeros((0, 1))
            return
        self.encoded = cut_lineage(rows.mapInArrow(_encode(spark.sparkContext.broadcast(number)), "doc_id bigint, codes binary"), "encoded")
        self.table = self._fit(min(rank, self.size), oversample, seed)

    def _summed(self, make, shape: str, names: list[str]) -> np.ndarray:
        """Column sums by word of what the tasks make: as many rows as the vocabulary has words come to the driver.

        Partial sums are as many as the cluster's cores demand, not as the corpus has splits.
        """
        few = self.encoded.coalesce(4 * self.spark.sparkContext.defaultParallelism)
        frame = few.mapInArrow(make, shape)
        got = frame.groupBy("word").agg(*[F.sum(c).alias(c) for c in names]).orderBy("word").toPandas()
        return got[names].to_numpy()

    def _fit(self, rank: int, oversample: int, seed: int) -> np.ndarray:
        held = self._summed(_count(self.size), "word bigint, held bigint", ["held"])
        if not len(held):
            return np.ones((self.size, 1))
        held = held[:, 0]
        self.idf = np.log2(1 + max(held[-1], 1) / np.maximum(held[:-1], 1))
        width = min(rank + oversample, self.size)
        names = [f"x{k}" for k in range(width)]
        shape = "word bigint, " + ", ".join(f"{c} double" for c in names)
        x = np.random.default_rng(seed).standard_normal((self.size, width))
        for _ in range(2):
            q, _ = np.linalg.qr(x)
            x = self._summed(_gram(self.spark.sparkContext.broadcast((self.idf, q))), shape, names)
        values, inner = np.linalg.eigh((q.T @ x + x.T @ q) / 2)
        self.singular = np.sqrt(np.maximum(values[::-1][:rank], 0))
        basis = q @ inner[:, ::-1][:, :rank]
        table = self.idf[:, None] * basis
        own = np.random.default_rng(seed + 1).uniform(0.5, 1, self.size) * 1e-3 * max(1e-12, float(np.linalg.norm(table, axis=1).mean()))
        return np.column_stack([table, own])

    def _item_windows(self, width: int, step: int = 1, least: int = 0):
        """Starts, items and unit latent vectors of the passages of ``width`` words of all items of ``least`` words or more, all items' codes
        behind each other."""
        flat = np.concatenate([*self.item_codes, np.zeros(0, dtype=np.int32)])
        ends = np.r_[0, np.cumsum([len(c) for c in self.item_codes])]
        starts, owner = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for k, c in enumerate(self.item_codes):
            if len(c) < max(width, least):
                continue
            s = np.unique(np.r_[np.arange(0, len(c) - width + 1, step), len(c) - width])
            starts.append(s + ends[k])
            owner.append(np.full(len(s), k))
        starts, owner = np.concatenate(starts), np.concatenate(owner)
        return flat, starts, owner, _latent(self.table, flat, starts, np.full(len(starts), width))

    def shared_runs(self, words: int = 10, cosine: float = 1 - 1e-8) -> DataFrame:
        """``(doc_id, item_id, run)``: documents and items that share ``words`` or more consecutive words, and the longest such run."""
        if not self.size or not any(len(c) >= words for c in self.item_codes):
            return self.spark.createDataFrame([], "doc_id bigint, item_id bigint, run bigint")
        flat, starts, owner, unit = self._item_windows(words)
        direction = np.random.default_rng(1).standard_normal(unit.shape[1])
        direction /= np.linalg.norm(direction)
        order = np.argsort(unit @ direction, kind="stable")
        ids = np.array([i for i, _, _ in self.items], dtype=np.int64)
        model = self.spark.sparkContext.broadcast((self.table, flat, starts[order], owner[order], unit[order], direction, ids))
        found = self.encoded.mapInArrow(_search_runs(model, words, cosine), "doc_id bigint, item_id bigint, run bigint")
        return found.groupBy("doc_id", "item_id").agg(F.max("run").alias("run"))

    def paraphrases(self, cosine: float = 0.8, share: float = 0.75, width: int = 16) -> DataFrame:
        """``(doc_id, item_id, cosine, lcs_share, has_answer)``: documents with a passage near an item's passage in latent space that also
        has at least ``share`` of its words in the same order.  One row per pair, the one of greatest ``lcs_share``.

        Passages have ``width`` words; an item with fewer is one passage, and so is a document.  They begin at every ``width // 4``-th word of a
        document and every ``width // 2``-th of an item, and at the last whole one of either.  A document's passage needs half of the words
        that the share demands of the wider span it is proved on, as no other could reach it.
        """
        kind = "doc_id bigint, item_id bigint, cosine double, lcs_share double, has_answer boolean"
        # Short items are searched by passages of their own length; there are fewer lengths than ``width``.
        widths = sorted({min(width, len(c)) for c in self.item_codes if len(c)}) if self.size else []
        if not widths:
            return self.spark.createDataFrame([], kind)
        ids = np.array([i for i, _, _ in self.items], dtype=np.int64)
        sets = []
        for w in widths:
            flat, starts, owner, unit = self._item_windows(w, max(1, w // 2))
            if w < width:
                own = np.array([len(self.item_codes[k]) == w for k in owner], dtype=bool)
                starts, owner, unit = starts[own], owner[own], unit[own]
            sets.append((w, flat, starts, owner, unit, _cells(unit)))
        model = self.spark.sparkContext.broadcast((self.table, ids, self.answers, sets))
        found = self.encoded.mapInArrow(_search_paraphrases(model, cosine, share), kind)
        best = F.max(F.struct("lcs_share", "cosine", "has_answer")).alias("b")
        return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.cosine", "b.lcs_share", "b.has_answer")


def _latent(table: np.ndarray, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Unit latent vectors of passages; words outside the vocabulary add nothing."""
    v = np.zeros((len(starts), table.shape[1]))
    for j in range(int(lengths.max(initial=0))):
        code = codes[np.minimum(starts + j, len(codes) - 1)]
        v += np.where(((code >= 0) & (j < lengths))[:, None], table[code], 0)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _cells(unit: np.ndarray, seed: int = 3) -> list[tuple[np.ndarray, float, np.ndarray]]:
    """Unit vectors in about as many cells as each cell has members: centre, widest angle to it, members."""
    n = len(unit)
    if not n:
        return []
    centres = unit[np.random.default_rng(seed).choice(n, max(1, int(np.sqrt(n))), replace=False)]
    for _ in range(3):
        of = np.concatenate([np.argmax(unit[k : k + 4096] @ centres.T, axis=1) for k in range(0, n, 4096)])
        total = np.zeros_like(centres)
        np.add.at(total, of, unit)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(length > 1e-12, total / np.maximum(length, 1e-12), centres)
    out = []
    for k in range(len(centres)):
        mine = np.flatnonzero(of == k)
        if len(mine):
            out.append((centres[k], float(np.arccos(np.clip(unit[mine] @ centres[k], -1, 1)).max()), mine))
    return out


def _near(mine: np.ndarray, unit: np.ndarray, cells, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of both whose cosine reaches the bound, and their cosines: only cells within reach are looked at."""
    angle = np.arccos(cosine)
    reach = np.cos(np.minimum(np.array([r for _, r, _ in cells]) + angle + 1e-6, np.pi))
    inside = mine @ np.stack([c for c, _, _ in cells]).T >= reach
    a, b, c = [], [], []
    for k, (_, _, members) in enumerate(cells):
        rows = np.flatnonzero(inside[:, k])
        for j in range(0, len(rows), 4096):
            close = mine[rows[j : j + 4096]] @ unit[members].T
            x, y = np.nonzero(close >= cosine)
            a.append(rows[j + x])
            b.append(members[y])
            c.append(close[x, y])
    whole = np.zeros(0, dtype=np.int64)
    return np.concatenate([whole, *a]), np.concatenate([whole, *b]), np.concatenate([np.zeros(0), *c])


def _search_runs(model, words: int, cosine: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, flat, item_start, owner, unit, direction, ids = model.value
        radius = np.sqrt(max(2 - 2 * cosine, 0)) + 1e-9
        projected = unit @ direction
        for key, codes, ends in (part for b in batches for part in _slices(b)):
            starts = _windows(codes >= 0, words)
            doc = np.searchsorted(ends, starts, "right") - 1
            whole = starts + words <= ends[doc + 1]
            starts, doc = starts[whole], doc[whole]
            # Only words that some window covers get a latent vector.
            covered = np.zeros(len(codes) + 1, dtype=np.int32)
            np.add.at(covered, starts, 1)
            np.add.at(covered, starts + words, -1)
            kept = np.cumsum(covered)[:-1] > 0
            inner, place = codes[kept], np.cumsum(kept) - 1
            out: list[tuple[np.ndarray, ...]] = []
            if len(starts):
                mine = _latent(table, inner, place[starts], np.full(len(starts), words))
                p = mine @ direction
                left, right = np.searchsorted(projected, p - radius, "left"), np.searchsorted(projected, p + radius, "right")
                n = right - left
                w = np.repeat(np.arange(len(starts)), n)
                i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(left, n)
                near = np.einsum("ij,ij->i", mine[w], unit[i]) >= cosine - 1e-12
                w, i = w[near], i[near]
                step = np.arange(words)
                equal = (codes[starts[w][:, None] + step] == flat[item_start[i][:, None] + step]).all(axis=1)
                w, i = w[equal], i[equal]
                out.append((doc[w], owner[i], starts[w], item_start[i]))
            if not out:
                continue
            d, o, s, t = (np.concatenate(x) for x in zip(*out, strict=True))
            if not len(d):
                continue
            # Windows that follow each other on both sides make one run.
            order = np.lexsort((s, s - t, o, d))
            d, o, s, t = d[order], o[order], s[order], t[order]
            new = np.r_[True, (d[1:] != d[:-1]) | (o[1:] != o[:-1]) | (s[1:] - t[1:] != s[:-1] - t[:-1]) | (s[1:] != s[:-1] + 1)]
            first = np.flatnonzero(new)
            run = np.diff(np.r_[first, len(d)]) + words - 1
            yield pa.RecordBatch.from_arrays([pa.array(key[d[first]]), pa.array(ids[o[first]]), pa.array(run)], names=["doc_id", "item_id", "run"])

    return search


def longest_common_subsequences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of the rows of two code matrices; negative codes match nothing."""
    last = np.zeros((len(b), b.shape[1] + 1), dtype=np.int16)
    for x in a.T:
        here = last.copy()
        here[:, 1:] = np.maximum(last[:, 1:], last[:, :-1] + ((b == x[:, None]) & (x >= 0)[:, None]))
        last = np.maximum.accumulate(here, axis=1)
    return last[:, -1]


def _bit(codes: np.ndarray) -> np.ndarray:
    """One of 64 bits for each word."""
    return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)


def _search_paraphrases(model, cosine: float, share: float):
    one_bit = np.uint64(1)

    def one(codes, ends, table, width, flat, item_start, owner, unit, cells):
        """Documents, items, cosines and shares of the passages of one width."""
        half, size = width // 2, np.diff(ends)
        known = np.r_[0, np.cumsum(codes >= 0)]
        at = np.arange(len(codes)) - np.repeat(ends[:-1], size)
        regular = (at % max(1, width // 4) == 0) & (at + width <= np.repeat(size, size))
        last = np.maximum(ends[1:] - width, ends[:-1])  # the last passage, or the whole of a shorter document
        starts = np.unique(np.r_[np.flatnonzero(regular), last])
        doc = np.searchsorted(ends, starts, "right") - 1
        length = np.minimum(width, size[doc])
        enough = known[starts + length] - known[starts] >= np.minimum(share * width / 2, np.maximum(1, length // 2))
        starts, doc, length = starts[enough], doc[enough], length[enough]
        for k in range(0, len(starts), 10_000):
            s, d, n = starts[k : k + 10_000], doc[k : k + 10_000], length[k : k + 10_000]
            ww, ii, near = _near(_latent(table, codes, s, n), unit, cells, cosine)
            place = s[:, None] + np.arange(-half, width + half)
            inside = (place >= ends[d][:, None]) & (place < ends[d + 1][:, None])
            span = np.where(inside, codes[np.clip(place, 0, len(codes) - 1)], -1)
            # A common subsequence has no more words than the item's passage has in the span; their bits bound that from above.
            held = np.bitwise_or.reduce(np.where(span >= 0, one_bit << _bit(span), 0).astype(np.uint64), axis=1)
            for j in range(0, len(ww), 100_000):
                w, i, c = ww[j : j + 100_000], ii[j : j + 100_000], near[j : j + 100_000]
                wanted = flat[item_start[i][:, None] + np.arange(width)]
                able = ((held[w][:, None] >> _bit(wanted)) & one_bit).sum(axis=1) >= share * width
                w, i, c = w[able], i[able], c[able]
                common = longest_common_subsequences(span[w], wanted[able]) / width
                good = common >= share
                yield d[w[good]], owner[i[good]], c[good], common[good]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, ids, answers, sets = model.value
        for key, codes, ends in (part for b in batches for part in _slices(b)):
            out = [x for passages in sets for x in one(codes, ends, table, *passages)]
            if not out:
                continue
            d, o, near, common = (np.concatenate(x) for x in zip(*out, strict=True))
            held = np.array([bool(len(answers[y])) and bool(np.isin(answers[y], codes[ends[x] : ends[x + 1]]).all()) for x, y in zip(d, o, strict=True)], dtype=bool)
            yield pa.RecordBatch.from_arrays([pa.array(key[d]), pa.array(ids[o]), pa.array(near), pa.array(common), pa.array(held)], names=["doc_id", "item_id", "cosine", "lcs_share", "has_answer"])

    return search
