"""Near-duplicate texts (problem 2): forests of signature trees.

A text is its set of words.  Two sets are alike if ``|both| / |either| >= threshold``.  The nodes of a signature tree hold the OR of their
members' word bitmaps and the ranges of their sizes and of the words they have left.  A dual traversal starts at pairs of roots and goes down
only where the greatest possible overlap of two nodes reaches what their least sizes demand:

    ``overlap <= min(A.most_left, B.most_left, popcount(A.bits & B.bits) + min(A.extra, B.extra))``

(``extra``: by how much a member's words left may exceed its bits, as words share bits).

One tree over everything would have to pair everything with everything near its root.  So there is one tree per key, a forest: words are
ordered from rare to common, alike sets must share one of their first ``n - ceil(t n) + 1`` words, and each of these is a key.  A pair is looked
for under the first word it shares, so what a set has left under a key are the words from there on: its bitmap holds only those.  This makes
the bounds of a common word's large tree sharp, as its members have used up their rare words.

A key with more than ``bucket_rows`` sets is split by the next shared word, which must be among the first ``n - ceil(t n) + 2``, and so on:
exact, without a cap.  What still is too large after ``levels`` words is laid out in pages in order of size; pages are nodes of a tree themselves,
and only pairs of pages whose greatest possible overlap suffices become tasks.

Sets that are equal are one node from the start, however many texts have them.  Every candidate pair is proved on its words.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlode.llm.words import records, sized, words_of
from termlode.plans.scratch import cut_lineage

HEAVY_PARTS = 20_000
FAN = 8
SETS = "rec_id bigint, h1 bigint, h2 bigint, codes array<bigint>, words array<string>"
ROW = "bucket bigint, side int, node bigint, n int, s int"


def bit_names(width: int) -> list[str]:
    return [f"b{k}" for k in range(width)]


def _row(width: int) -> str:
    return ", ".join([ROW, *(f"{b} bigint" for b in bit_names(width))])


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _word_code(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "big")


def _word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes: dict[str, int] = {}
    for b in batches:
        keys, h1, h2, sets, texts = [], [], [], [], []
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found = sorted(set(words_of(text)))
            if not found:
                continue
            if len(codes) > 500_000:
                codes.clear()
            own = []
            for w in found:
                c = codes.get(w)
                if c is None:
                    c = codes[w] = _word_code(w)
                own.append(c)
            digest = hashlib.blake2b(" ".join(found).encode("utf-8", "surrogatepass"), digest_size=16).digest()  # words hold no blank
            keys.append(key)
            h1.append(int.from_bytes(digest[:8], "big", signed=True))
            h2.append(int.from_bytes(digest[8:], "big", signed=True))
            sets.append(own)
            texts.append(found)
        columns = [pa.array(keys, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sets, pa.list_(pa.int64())), pa.array(texts, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=["rec_id", "h1", "h2", "codes", "words"])


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values behind each other, and the length of each list."""
    return lists.values.to_numpy(zero_copy_only=False)[lists.offsets[0].as_py() : lists.offsets[-1].as_py()], np.diff(lists.offsets.to_numpy()).astype(np.int64)


def _order(ranks):
    """Words of each set from rare to common, each as rank << 56 | code."""

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, rank = ranks.value
        for b in batches:
            flat, n = _flat(b.column(1))
            owner = np.repeat(np.arange(len(n)), n)
            if len(codes):
                at = np.minimum(np.searchsorted(codes, flat), len(codes) - 1)
                flat = flat | np.where(codes[at] == flat, rank[at] << 56, 0)
            words = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(flat[np.lexsort((flat, owner))], pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype(np.int32)), words], names=["node", "n", "words"])

    return order


def _word_bits(flat: np.ndarray, width: int) -> np.ndarray:
    """A bitmap of ``width`` x 64 bits with one bit for each word, and an empty one at the end."""
    hashed = (flat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - int(math.log2(width * 64)))
    one = np.zeros((len(flat) + 1, width), dtype=np.uint64)
    one[np.arange(len(flat)), (hashed >> np.uint64(6)).astype(np.int64)] = np.uint64(1) << (hashed & np.uint64(63))
    return one


def _or_between(one: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Bitmaps of the words from ``first`` up to ``last``, for each row."""
    out = np.zeros((len(first), one.shape[1]), dtype=np.uint64)
    some = np.flatnonzero(first < last)
    if len(some):
        out[some] = np.bitwise_or.reduceat(one, np.stack([first[some], last[some]], axis=1).ravel(), axis=0)[::2]
    return out


def _left_bits(flat: np.ndarray, start: np.ndarray, prefix: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """For each row and each of its first ``prefix`` words the bitmap of the words from there on, each made from the next one's."""
    one = _word_bits(flat, width)
    held = _or_between(one, start + prefix, start + n)
    out = np.empty((int(prefix.sum()), width), dtype=np.uint64)
    place = np.cumsum(prefix) - prefix
    order = np.argsort(-prefix, kind="stable")
    longest = -prefix[order]
    for j in range(int(prefix.max(initial=0)) - 1, -1, -1):
        rows = order[: np.searchsorted(longest, -j, "left")]  # those with more than j first words
        held[rows] |= one[start[rows] + j]
        out[place[rows] + j] = held[rows]
    return out


def _rows(bucket, node, n, s, bits) -> pa.RecordBatch:
    whole = [pa.array(bucket), pa.array(np.zeros(len(node), dtype=np.int32)), pa.array(node), pa.array(n.astype(np.int32)), pa.array(s.astype(np.int32)), *(pa.array(bits[:, k].view(np.int64)) for k in range(bits.shape[1]))]
    return pa.RecordBatch.from_arrays(whole, names=_names(_row(bits.shape[1])))


def _first_keys(threshold: float, width: int):
    """A row under each of a set's first words."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, n = _flat(b.column(2))
            start = np.r_[0, np.cumsum(n)][:-1]
            prefix = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
            row = np.repeat(np.arange(len(n)), prefix)
            pos = np.arange(prefix.sum()) - np.repeat(np.cumsum(prefix) - prefix, prefix)
            first = start[row] + pos
            yield _rows(flat[first], b.column(0).to_numpy()[row], n[row], n[row] - pos, _left_bits(flat, start, prefix, n, width))

    return make


def _later_keys(level: int, width: int):
    """Rows ``(key, pos, ends, node, n, words)`` under keys of ``level`` words, the last of them at ``pos``; ``ends``: no more words are shared."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, pos, ends, node = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            flat, n = _flat(b.column(5))
            start = np.r_[0, np.cumsum(n)][:-1]
            ends = ends.astype(bool)
            first = np.where(ends, start + n, start + pos)
            s = np.where(ends, level, level - 1 + n - pos)
            yield _rows(key, node, n, s, _or_between(_word_bits(flat, width), first, start + n))

    return make


def shared_bits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits that are set in both bitmaps, row by row."""
    count = np.bitwise_count(x & y)
    while count.shape[1] > 1:  # a power of two
        count = count[:, ::2].astype(np.uint16) + count[:, 1::2]
    return count[:, 0].astype(np.int32)


def needed(n_a, n_b, threshold: float):
    """The least overlap of two sets of these sizes that are alike."""
    return np.ceil(threshold / (1 + threshold) * (n_a + n_b) - 1e-9)


class _Level:
    """The nodes of one height of a forest."""

    def __init__(self, tree, bits, least, most, left, extra, first, last) -> None:
        self.tree, self.bits, self.least, self.most, self.left, self.extra, self.first, self.last = tree, bits, least, most, left, extra, first, last

    def above(self) -> _Level:
        """Groups of up to FAN neighbours of the same tree."""
        n = len(self.tree)
        new = np.r_[True, self.tree[1:] != self.tree[:-1]]
        starts = np.flatnonzero(new)
        rank = np.arange(n) - np.repeat(starts, np.diff(np.r_[starts, n]))
        first = np.flatnonzero(rank % FAN == 0)
        most = lambda x: np.maximum.reduceat(x, first)
        return _Level(self.tree[first], np.bitwise_or.reduceat(self.bits, first, axis=0), np.minimum.reduceat(self.least, first), most(self.most), most(self.left), most(self.extra), first, np.r_[first[1:], n])

    def possible(self, a, b, threshold: float, need_of: np.ndarray):
        """Positions of the pairs whose greatest possible overlap reaches what their least sizes demand; ``need_of``: by sum of sizes.

        For two sets the words left say all that their sizes say, as a set too small for another can't have enough left.
        """
        need = need_of[self.least[a] + self.least[b]]
        fits = np.minimum(self.left[a], self.left[b]) >= need
        if self.first is not None:
            fits &= (self.most[a] >= threshold * self.least[b] - 1e-9) & (self.most[b] >= threshold * self.least[a] - 1e-9)
        fits = np.flatnonzero(fits)
        a, b = a[fits], b[fits]
        return fits[shared_bits(self.bits[a], self.bits[b]) + np.minimum(self.extra[a], self.extra[b]) >= need[fits]]


def dual_traversal(bucket, side, n, left, bits, threshold: float, *, frontier: int = 1_000_000, tested: list | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of the same bucket that may be alike.  Rows are sorted by (bucket, side); within side 0 all pairs count, else side 1 x 2.

    At most about ``frontier`` node pairs are held at a time, whatever the trees' sizes.  ``tested`` gets (height, tested, kept) of each step.
    """
    tree = np.cumsum(np.r_[True, (bucket[1:] != bucket[:-1]) | (side[1:] != side[:-1])]) - 1
    n, left = n.astype(np.int32), left.astype(np.int32)
    need_of = needed(np.arange(2 * int(n.max(initial=0)) + 1), 0, threshold).astype(np.int32)
    levels = [_Level(tree, bits, n, n, left, left - np.bitwise_count(bits).sum(axis=1, dtype=np.int32), None, None)]
    while len(levels[-1].tree) > tree[-1] + 1 or len(levels) == 1:
        levels.append(levels[-1].above())
    top = levels[-1]
    start = np.searchsorted(tree, top.tree)
    tree_bucket, tree_side = bucket[start], side[start]
    inner = np.flatnonzero(tree_side == 0)
    crossing = np.flatnonzero((tree_side[:-1] == 1) & (tree_side[1:] == 2) & (tree_bucket[:-1] == tree_bucket[1:]))
    todo = [(len(levels) - 1, np.r_[inner, crossing], np.r_[inner, crossing + 1])]
    while todo:
        height, a, b = todo.pop()
        level, below = levels[height], levels[height - 1]
        na, nb = level.last[a] - level.first[a], level.last[b] - level.first[b]
        each = na * nb
        done = np.cumsum(each)
        if len(a) > 1 and done[-1] > frontier:
            cut = max(1, int(np.searchsorted(done, frontier)))
            todo += [(height, a[cut:], b[cut:]), (height, a[:cut], b[:cut])]
            continue
        at = np.arange(done[-1] if len(done) else 0) - np.repeat(done - each, each)
        wide = np.repeat(nb, each)
        ca = np.repeat(level.first[a], each) + at // wide
        cb = np.repeat(level.first[b], each) + at % wide
        same = np.repeat(a == b, each)
        ok = ~same | (ca <= cb if height > 1 else ca < cb)
        ca, cb = ca[ok], cb[ok]
        keep = below.possible(ca, cb, threshold, need_of)
        if tested is not None:
            tested.append((height - 1, len(ca), len(keep)))
        if height == 1:
            yield ca[keep], cb[keep]
        elif len(keep):
            todo.append((height - 1, ca[keep], cb[keep]))


def _join_forests(threshold: float, chunk_rows: int):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def tables():
            """Whole buckets, about ``chunk_rows`` rows together."""
            nonlocal rest
            for b in batches:
                t = pa.Table.from_batches([b])
                rest = t if rest is None or not rest.num_rows else pa.concat_tables([rest, t])
                if rest.num_rows >= chunk_rows:
                    bucket = rest.column(0).to_numpy()
                    last = int(np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])[-1])
                    if last:
                        yield rest.slice(0, last)
                        rest = rest.slice(last)
            if rest is not None and rest.num_rows:
                yield rest

        for t in tables():
            bucket, side, node, n, left = (t.column(k).to_numpy() for k in range(5))
            bits = np.stack([t.column(5 + k).to_numpy() for k in range(t.num_columns - 5)], axis=1).view(np.uint64)
            new = np.r_[True, bucket[1:] != bucket[:-1]]
            many = np.diff(np.r_[np.flatnonzero(new), len(bucket)]) > 1  # a set that is alone under a key has no partner there
            row = np.flatnonzero(np.repeat(many, np.diff(np.r_[np.flatnonzero(new), len(bucket)])))
            if not len(row):
                continue
            for a, b in dual_traversal(bucket[row], side[row], n[row], left[row], bits[row], threshold):
                a, b = node[row[a]], node[row[b]]
                differ = a != b
                a, b = a[differ], b[differ]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["node_a", "node_b"])

    return join


def _number_pages(page_rows: int):
    """Neighbours of a bucket in pages of ``page_rows``; a page's number also tells its task."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        page, held, last = TaskContext.get().partitionId() << 32, 0, None
        for b in batches:
            out = np.empty(b.num_rows, dtype=np.int64)
            for k, bucket in enumerate(b.column(0).to_pylist()):
                if bucket != last or held == page_rows:
                    page, held, last = page + 1, 0, bucket
                out[k] = page
                held += 1
            yield pa.RecordBatch.from_arrays([pa.array(out), *b.columns], names=["page", *b.schema.names])

    return number


class NearDuplicates:
    """Groups of alike texts: ``members`` (rec_id, node) and ``links`` (node_a, node_b, overlap, similarity) between nodes.

    A node is a set of words, named by the least key that has it.  Repeated rows of a key count once; NULL, empty and wordless texts
    belong to no node; NULL keys are left out; an empty table gives no rows.
    """

    def __init__(self, df: DataFrame, key: str, text: str, threshold: float = 0.7, *, bucket_rows: int = 10_000, levels: int = 6, chunk_rows: int = 100_000) -> None:
        if not 0 < threshold <= 1:
            raise ValueError("threshold must be above 0 and at most 1")
        self.spark, self.threshold = df.sparkSession, threshold
        sets = cut_lineage(records(df, key, text).where("text IS NOT NULL").mapInArrow(_word_sets, SETS), "sets")
        nodes = sets.groupBy("h1", "h2").agg(F.min("rec_id").alias("node"))
        self.members = cut_lineage(sets.select("rec_id", "h1", "h2").join(nodes, ["h1", "h2"]).select("rec_id", "node"), "members")
        copies = cut_lineage(self.members.where("rec_id != node").select("rec_id"), "copies")
        distinct = sets.join(sized(copies), "rec_id", "left_anti").select(F.col("rec_id").alias("node"), "codes", "words")
        self.words = distinct.select("node", "words")
        codes = distinct.select("node", "codes")
        self.ordered = cut_lineage(codes.mapInArrow(_order(self._ranks(codes)), "node bigint, n int, words array<bigint>"), "ordered")
        self.links = self._links(bucket_rows, levels, chunk_rows)

    def _ranks(self, distinct: DataFrame):
        """Ranks of the words that make up at least one part in HEAVY_PARTS of all: at most HEAVY_PARTS.  All others are rare, of rank 0."""
        total, held = distinct.agg(F.coalesce(F.sum(F.size("codes")), F.lit(0)), F.count("*")).collect()[0]
        # About eight bits for each word of a set, between 256 and 1024: a set has a bitmap under each of its keys.
        self.width = 1 << max(2, min(4, math.ceil(math.log2(max(1, total / max(1, held)) / 8))))
        floor = max(2, math.ceil(total / HEAVY_PARTS))
        heavy = distinct.select(F.explode("codes").alias("w")).groupBy("w").count().where(F.col("count") >= floor).collect()
        pairs = sorted((r["w"], 1 + min(100, int(3 * math.log2(r["count"] / floor)))) for r in heavy)
        codes = np.array([p[0] for p in pairs], dtype=np.int64)
        return self.spark.sparkContext.broadcast((codes, np.array([p[1] for p in pairs], dtype=np.int64)))

    def buckets(self, bucket_rows: int, levels: int) -> DataFrame:
        """The rows of all trees."""
        t = F.lit(self.threshold)
        row, names = _row(self.width), _names(_row(self.width))
        rows = self.ordered.withColumn("least", F.ceil(t * F.col("n") - F.lit(1e-9)).cast("int")).withColumn("prefix", F.col("n") - F.col("least") + 1)
        rows = rows.select("*", F.posexplode(F.slice("words", F.lit(1), F.col("prefix"))).alias("pos", "key")).withColumn("ends", F.lit(False))
        parts: list[DataFrame] = []
        for level in range(1, levels + 1):
            # Hot keys are written down: they are few (a row for every bucket_rows rows at most), and the levels below build on them.
            hot = cut_lineage(rows.groupBy("key").count().where(F.col("count") > bucket_rows).select("key"), f"hot{level}")
            some = hot.limit(1).count()
            made = self.ordered.mapInArrow(_first_keys(self.threshold, self.width), row) if level == 1 else self._made(rows, level)
            parts.append(made.join(hot.withColumnRenamed("key", "bucket"), "bucket", "left_anti").select(*names) if some else made)
            if not some:
                break
            over = cut_lineage(rows.join(hot, "key"), f"over{level}")
            if level == levels:
                parts.append(self._pages(self._made(over, level), bucket_rows))
                break
            parts.append(self._pages(self._made(over.where("ends"), level), bucket_rows))  # their sets share nothing beyond the key
            over = over.where("NOT ends")
            # The next shared word stands behind the last one and among the first prefix + level words.
            follow = over.withColumnRenamed("pos", "was").select("*", F.posexplode(F.expr(f"slice(words, was + 2, greatest(prefix + {level} - was - 1, 0))")).alias("step", "w"))
            follow = follow.withColumn("pos", F.col("was") + 1 + F.col("step")).withColumn("key", F.xxhash64("key", "w"))
            # Small sets may share the key's words and no more.
            ended = over.where(F.col("least") <= level).withColumn("key", F.xxhash64("key", F.lit(-1))).withColumn("ends", F.lit(True))
            rows = cut_lineage(follow.select(rows.columns).unionByName(ended.select(rows.columns)), f"rows{level + 1}")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _made(self, rows: DataFrame, level: int) -> DataFrame:
        return rows.select("key", "pos", "ends", "node", "n", "words").mapInArrow(_later_keys(level, self.width), _row(self.width))

    def _pages(self, rows: DataFrame, page_rows: int) -> DataFrame:
        """Rows of oversized buckets, once for every pair of pages that theirs is in and that may hold a pair."""
        paged = cut_lineage(rows.repartitionByRange("bucket", "n", "s", "node").sortWithinPartitions("bucket", "n", "s").mapInArrow(_number_pages(page_rows), "page bigint, " + _row(self.width)), "pages")
        bits = bit_names(self.width)
        extra = F.col("s") - sum((F.bit_count(b) for b in bits), F.lit(0))
        pages = paged.groupBy("bucket", "page").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("s").alias("left"), F.max(extra).alias("extra"), *[F.bit_or(b).alias(b) for b in bits])
        a, b = pages.alias("a"), pages.alias("b")
        need = F.lit(self.threshold / (1 + self.threshold)) * (F.col("a.least") + F.col("b.least")) - F.lit(1e-9)
        shared = sum((F.bit_count(F.col(f"a.{x}").bitwiseAND(F.col(f"b.{x}"))) for x in bits), F.least("a.extra", "b.extra"))
        t = F.lit(self.threshold)
        fits = (F.col("a.most") >= t * F.col("b.least") - F.lit(1e-9)) & (F.col("b.most") >= t * F.col("a.least") - F.lit(1e-9)) & (F.least("a.left", "b.left") >= need) & (shared >= need)
        pairs = a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.page") <= F.col("b.page")) & fits).select(F.col("a.page").alias("x"), F.col("b.page").alias("y"))
        sides = pairs.select(F.xxhash64("x", "y").alias("pair"), F.explode(F.when(F.col("x") == F.col("y"), F.array(F.struct(F.col("x").alias("page"), F.lit(0).alias("of")))).otherwise(F.array(F.struct(F.col("x").alias("page"), F.lit(1).alias("of")), F.struct(F.col("y").alias("page"), F.lit(2).alias("of"))))).alias("z"))
        each = paged.join(sides.select("pair", "z.page", "z.of"), "page")
        return each.select(F.col("pair").alias("bucket"), F.col("of").alias("side"), *_names(_row(self.width))[2:])

    def _links(self, bucket_rows: int, levels: int, chunk_rows: int) -> DataFrame:
        rows = self.buckets(bucket_rows, levels).repartition("bucket").sortWithinPartitions("bucket", "side", "n", "s")
        pairs = cut_lineage(rows.mapInArrow(_join_forests(self.threshold, chunk_rows), "node_a bigint, node_b bigint").distinct(), "candidates")
        # The proof needs the words of candidates only.
        named = cut_lineage(pairs.select(F.explode(F.array("node_a", "node_b")).alias("node")).distinct(), "named")
        words = self.words.join(sized(named), "node", "left_semi")
        proof = pairs.join(words.select(F.col("node").alias("node_a"), F.col("words").alias("wa")), "node_a").join(words.select(F.col("node").alias("node_b"), F.col("words").alias("wb")), "node_b")
        proof = proof.withColumn("overlap", F.size(F.array_intersect("wa", "wb"))).withColumn("either", F.size("wa") + F.size("wb") - F.col("overlap"))
        return proof.where(F.col("overlap") >= F.lit(self.threshold - 1e-12) * F.col("either")).select("node_a", "node_b", "overlap", (F.col("overlap") / F.col("either")).alias("similarity"))

    def pairs(self) -> DataFrame:
        """``(a, b)``, a < b: every two records alike, also those with equal sets.  As many rows as there are such pairs."""
        x, y = self.members.select(F.col("rec_id").alias("a"), F.col("node").alias("node_a")), self.members.select(F.col("rec_id").alias("b"), F.col("node").alias("node_b"))
        across = self.links.join(x, "node_a").join(y, "node_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        shared = self.members.groupBy("node").count().where("count > 1").select("node")
        multi = self.members.join(shared, "node", "left_semi")
        inside = multi.select(F.col("rec_id").alias("a"), "node").join(multi.select(F.col("rec_id").alias("b"), "node"), "node").where("a < b").select("a", "b")
        return across.unionByName(inside)

    def groups(self) -> DataFrame:
        """``(rec_id, group_id, links)``: for each record its group - records joined by links, directly or through others - named by its
        least key, and to how many other word sets its own is linked.  Least labels spread along links until none changes."""
        edges = cut_lineage(self.links.select("node_a", "node_b"), "links")
        both = edges.unionByName(edges.select(F.col("node_b").alias("node_a"), F.col("node_a").alias("node_b")))
        labels = both.groupBy("node_a").agg(F.count("*").alias("links")).select(F.col("node_a").alias("node"), F.col("node_a").alias("label"), "links")
        moved = 1
        while moved:
            near = both.join(labels.select(F.col("node").alias("node_b"), "label"), "node_b").groupBy(F.col("node_a").alias("node")).agg(F.min("label").alias("near"))
            step = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), "links", (F.col("near") < F.col("label")).alias("moved"))
            # Pointer jumping: a node also takes the label of its label, so long chains shorten fast.
            jump = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
            step = cut_lineage(step.join(jump, "label", "left").select("node", F.least("label", "far").alias("label"), "links", "moved"), "labels")
            labels = step.drop("moved")
            moved = step.where("moved").limit(1).count()
        return self.members.join(labels, "node", "left").select("rec_id", F.coalesce("label", "node").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
