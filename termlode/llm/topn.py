"""Top N items of every group (problem 6): sorted runs and a loser-tree merge.

1. Each task turns its rows into sorted runs, in order of group, score (highest first) and item.  A run keeps, of each group, only the
   first N different items: what a run drops can't be among the group's N best.  A group with a third of all rows thus sends at most N
   rows per run.
2. Runs are stored by bucket of the group's hash: the exchange writes them, by run and position, to the shuffle store.  There are as many
   buckets as the rows demand, each of about ``bucket_rows``.
3. One task for each bucket merges its runs with a loser tree.  The tree plays on (group, score, item); after N outputs of a group every
   run jumps to the start of its own next group, which it has noted, without looking at what lies between.  Results leave in batches.
4. A merge takes up to ``fan_in`` runs.  Where there are more, merges of ``fan_in`` make longer runs first, and so on, so that a group with rows in
   every run never has more than N rows for each of ``fan_in`` runs in one task.

Groups that only one run holds are copied as a slice, without a game.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = "bucket int, run bigint, at bigint, g1 bigint, g2 bigint, score double, item bigint"
_COLUMNS = [c.split()[0] for c in RUN.split(", ")]
OUT = "g1 bigint, g2 bigint, score double, item bigint, rank int"


class LoserTree:
    """Tournament over k runs; ``winner`` is the run with the least head.  A head of None has lost to every other."""

    def __init__(self, heads: list) -> None:
        self.k = max(1, len(heads))
        self.heads = heads or [None]
        self.tree = [-1] * self.k
        for leaf in range(self.k):
            self._play(leaf, filling=True)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None and (x is not None or a < b) if x is None or y is None else (x, a) < (y, b)

    def _play(self, leaf: int, filling: bool = False) -> None:
        node, best = (leaf + self.k) // 2, leaf
        while node:
            rival = self.tree[node]
            if rival < 0:
                if filling:
                    self.tree[node] = best
                    return
            elif self._less(rival, best):
                self.tree[node], best = best, rival
            node //= 2
        self.tree[0] = best

    @property
    def winner(self) -> int:
        return self.tree[0]

    def replace(self, head) -> None:
        """The winner's run moves on to ``head``."""
        leaf = self.tree[0]
        self.heads[leaf] = head
        self._play(leaf)


def _first_items(g1, g2, score, item, n: int) -> np.ndarray:
    """Positions, in order of (g1, g2, -score, item), of the first n different items of each group; ties by item."""
    order = np.lexsort((item, -score, g2, g1))
    g1, g2, item = g1[order], g2[order], item[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])
    group = np.cumsum(new) - 1
    # An item's first place is its best score; later ones of the same group fall away.
    same = np.lexsort((np.arange(len(order)), item, group))
    first = np.ones(len(order), dtype=bool)
    first[1:] = (group[same][1:] != group[same][:-1]) | (item[same][1:] != item[same][:-1])
    keep = np.sort(same[first])
    starts = np.flatnonzero(np.r_[True, group[keep][1:] != group[keep][:-1]]) if len(keep) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(keep)) - np.repeat(starts, np.diff(np.r_[starts, len(keep)]))
    return order[keep[rank < n]]


def _runs(n: int, run_rows: int, per_task: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        task = TaskContext.get()
        run = (task.partitionId() if task else os.getpid()) * per_task
        held: list[pa.RecordBatch] = []

        def cut() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            bucket, g1, g2, score, item = (t.column(k).to_numpy() for k in range(5))
            at = _first_items(g1, g2, score, item, n)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (bucket[at], np.full(len(at), run), np.arange(len(at)), g1[at], g2[at], score[at], item[at])], names=_COLUMNS)

        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= run_rows:
                yield cut()
                held, rows, run = [], 0, run + 1
        if rows:
            yield cut()

    return make


class _Run:
    """One stored run of a bucket: rows in order, the starts of its groups, and a cursor."""

    def __init__(self, g1, g2, score, item) -> None:
        self.score, self.item = score, item
        new = np.ones(len(item), dtype=bool)
        new[1:] = (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])
        self.starts = np.r_[np.flatnonzero(new), len(item)].tolist()
        self.groups = list(zip(g1[new].tolist(), g2[new].tolist(), strict=True))
        self.group, self.at = 0, 0

    def head(self):
        if self.group == len(self.groups):
            return None
        return (*self.groups[self.group], -self.score[self.at], self.item[self.at])

    def step(self) -> None:
        self.at += 1
        if self.at == self.starts[self.group + 1]:
            self.group += 1

    def seek_past(self, group) -> None:
        """To the first row behind ``group``."""
        if self.group < len(self.groups) and self.groups[self.group] == group:
            self.group += 1
            self.at = self.starts[self.group]


def _ranked(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["g1", "g2", "score", "item", "rank"])


def _merge(runs: list[_Run], n: int, batch_rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    tree = LoserTree([r.head() for r in runs])
    while True:
        lead = runs[tree.winner]
        head = tree.heads[tree.winner]
        if head is None:
            break
        group, taken = head[:2], []
        seen: set[int] = set()
        while head is not None and head[:2] == group:
            run = runs[tree.winner]
            if head[3] not in seen:
                seen.add(head[3])
                taken.append((*group, -head[2], head[3], len(taken) + 1))
            if len(taken) == n:
                run.seek_past(group)
            else:
                run.step()
            tree.replace(run.head())
            lead = runs[tree.winner]
            if len(taken) == n:
                while (h := tree.heads[tree.winner]) is not None and h[:2] == group:
                    lead.seek_past(group)
                    tree.replace(lead.head())
                    lead = runs[tree.winner]
            head = tree.heads[tree.winner]
        out += taken
        if len(out) >= batch_rows:
            yield _ranked(out)
            out = []
    if out:
        yield _ranked(out)


def _merge_buckets(n: int, fan_in: int | None = None):
    """Merges the runs of each bucket; with ``fan_in`` into longer runs, else into the result."""

    def merged(t: pa.Table) -> Iterator[pa.RecordBatch]:
        _, run, _, g1, g2, score, item = (t.column(k).to_numpy() for k in range(7))
        cuts = np.r_[0, np.flatnonzero(np.diff(run)) + 1, len(run)]
        if len(cuts) == 2:  # one run: it is the result
            starts = np.flatnonzero(np.r_[True, (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])])
            rank = np.arange(len(run)) - np.repeat(starts, np.diff(np.r_[starts, len(run)])) + 1
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g1, g2, score, item, rank.astype(np.int32))], names=["g1", "g2", "score", "item", "rank"])
        else:
            yield from _merge([_Run(g1[x:y], g2[x:y], score[x:y], item[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)], n)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def done() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            held.clear()
            if fan_in is None:
                yield from merged(t)
                return
            at = 0
            for b in merged(t):
                rows = b.num_rows
                own = [pa.array(np.full(rows, x)) for x in (np.int32(now[0]), np.int64(now[1]))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.arange(at, at + rows)), *b.columns[:4]], names=_COLUMNS)
                at += rows

        for b in batches:
            bucket, run = b.column(0).to_numpy(), b.column(1).to_numpy()
            of = run // fan_in if fan_in else np.zeros(len(run), dtype=np.int64)
            edges = np.r_[0, np.flatnonzero((np.diff(bucket) != 0) | (np.diff(of) != 0)) + 1, len(bucket)]
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if x == y:
                    continue
                if held and now != (int(bucket[x]), int(of[x])):
                    yield from done()
                now = (int(bucket[x]), int(of[x]))
                held.append(b.slice(x, y - x))
        if held:
            yield from done()

    return merge


def top_n(df: DataFrame, group: tuple[str, str], item: str, score: str, n: int = 10, *, run_rows: int = 1_000_000, bucket_rows: int = 500_000, fan_in: int = 512) -> DataFrame:
    """``(g1, g2, item, score, rank)``: the up to n different items of each group with the highest score, ties by the smaller item.

    NULL and NaN are no scores and fall away, as do rows with a NULL in group or item; zero (also -0.0) is a score.  An item counts once
    in a group, with its highest score, so repeated rows change nothing.  A group with fewer scored items gives those; an empty table
    gives no row.
    """
    g1, g2, it, sc = (F.col(f"`{c}`") for c in (*group, item, score))
    rows = df.select(g1.cast("bigint").alias("g1"), g2.cast("bigint").alias("g2"), (sc.cast("double") + F.lit(0.0)).alias("score"), it.cast("bigint").alias("item"))
    held = df.count()  # of a table of files this reads their footers only
    buckets = max(1, -(-held // bucket_rows), min(df.sparkSession.sparkContext.defaultParallelism, -(-held // 20_000)))
    rows = rows.where("g1 IS NOT NULL AND g2 IS NOT NULL AND item IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)")
    rows = rows.select(F.pmod(F.xxhash64("g1", "g2"), F.lit(buckets)).cast("int").alias("bucket"), "g1", "g2", "score", "item")
    # Runs are numbered by task and place in the task; a task has as many as its rows demand.
    per_task = 1 << 20
    most = max(1, rows.rdd.getNumPartitions()) * per_task
    runs = rows.mapInArrow(_runs(n, run_rows, per_task), RUN)
    while most > fan_in * per_task:
        runs = runs.repartition(buckets, "bucket", F.floor(F.col("run") / fan_in)).sortWithinPartitions("bucket", "run", "at").mapInArrow(_merge_buckets(n, fan_in), RUN)
        most = -(-most // fan_in)
    return runs.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "run", "at").mapInArrow(_merge_buckets(n), OUT)
