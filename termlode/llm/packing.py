"""Filling fixed-capacity containers (problem 7): mixture-controlled packing by deficit round-robin.

The corpus need not have the mixture that is wanted.  It holds the target up to the point where the first source is used up; from there on
the sources that are left keep their proportions, until the next one is used up, and so on: phases, worked out from the token totals of the
sources alone.  A source's documents are spread over the phases by the hash of their id, each phase getting the tokens that it has room for,
and within a phase over shards of bounded size.  So every shard holds the mixture of its phase, a source with a third of all rows is in every
shard in its share, and only what comes after the end of a source is off target.  A shard is packed by one task:

* each source is a queue; a window is ``window_containers`` capacities of tokens;
* in each window a queue's deficit grows by its target share of the window, and the queue serves documents while its next one is covered;
  what is left of the deficit is carried to the next window;
* what the window drew is placed best-fit decreasing into the open containers and new ones; containers stay open across windows.

Deficits are carried across shards too, without making shards wait for each other: every shard drains its queues, so what a queue is owed
when a shard begins is its share of all tokens of earlier shards of its phase minus its own tokens there - prefix sums of a (shard, source)
table.

A document is split only if it exceeds the capacity: into full containers and one rest, which is packed as any other item.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACED = (
    "container_kind string, capacity bigint, shard bigint, container bigint, doc_id bigint, source string, piece int, pieces int, first_token bigint, tokens bigint, window int"
)


def byt5_tokens(text: Column) -> Column:
    """Tokens of the byte-level tokenizer of ByT5: one per byte of the UTF-8 text and one end token."""
    return (F.octet_length(text) + F.lit(1)).cast("bigint")


class _Bins:
    """Open containers by free room."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.free, self.count = capacity, [], 0

    def place(self, tokens: int) -> int:
        """Best fit: the container with the least room that is enough, else a new one; gives its number."""
        at = bisect_left(self.free, (tokens, -1))
        if at < len(self.free):
            room, number = self.free.pop(at)
        else:
            room, number = self.capacity, self.count
            self.count += 1
        if room > tokens:
            insort(self.free, (room - tokens, number))
        return number


def pack_shard(ids, tokens, sources, shares: dict[str, float], owed: dict[str, float], capacity: int, window_containers: int) -> list[tuple]:
    """``(row, container, piece, pieces, first_token, tokens, window)`` for every piece of every row."""
    queues: dict[str, list[int]] = {}
    for row in np.lexsort((ids,)).tolist():
        queues.setdefault(sources[row], []).append(row)
    at = dict.fromkeys(queues, 0)
    deficit = {s: owed.get(s, 0.0) for s in queues}
    budget = float(window_containers * capacity)
    bins, out, window = _Bins(capacity), [], 0
    while queues:
        live = sum(shares.get(s, 0.0) for s in queues)
        part = {s: shares.get(s, 0.0) / live if live > 0 else 1 / len(queues) for s in queues}
        drawn: list[int] = []
        # A window in which every queue is in arrears would draw nothing; such windows are passed over at once.
        wait = min((tokens[q[at[s]]] - deficit[s]) / (budget * part[s]) if part[s] > 0 else np.inf for s, q in queues.items())
        skip = max(1.0, np.ceil(wait))
        for s in sorted(queues):
            q = queues[s]
            deficit[s] += skip * budget * part[s]
            k = at[s]
            while k < len(q) and tokens[q[k]] <= deficit[s]:
                deficit[s] -= tokens[q[k]]
                drawn.append(q[k])
                k += 1
            at[s] = k
        queues = {s: q for s, q in queues.items() if at[s] < len(q)}
        items = []
        for row in drawn:
            size = int(tokens[row])
            whole, rest = divmod(size, capacity) if size > capacity else (0, size)
            pieces = whole + (rest > 0)
            for p in range(whole):
                out.append((row, bins.count, p + 1, pieces, p * capacity, capacity, window))
                bins.count += 1
            if rest:
                items.append((rest, row, pieces, size - rest))
        items.sort(key=lambda x: (-x[0], x[1]))
        for rest, row, pieces, first in items:
            out.append((row, bins.place(rest), pieces, pieces, first, rest, window))
        window += 1
    return out


def phases(totals: dict[str, int], targets: dict[str, float] | None) -> list[tuple[dict[str, float], dict[str, float]]]:
    """``(shares, tokens)`` by source of each phase: the mixture that it holds, and how much of a source belongs to it.

    Without targets there is one phase with the mixture of the totals.  Sources that targets don't name come last.
    """
    left = {s: float(t) for s, t in totals.items() if t > 0}
    if targets is None:
        targets = dict(left)
    out = []
    while left:
        named = {s: targets.get(s, 0.0) for s in left if targets.get(s, 0.0) > 0} or dict(left)
        weight = sum(named.values())
        shares = {s: w / weight for s, w in named.items()}
        room = min(left[s] / shares[s] for s in shares)
        used = {s: left[s] if left[s] <= room * shares[s] * (1 + 1e-9) else room * shares[s] for s in shares}
        out.append((shares, used))
        left = {s: t - used.get(s, 0.0) for s, t in left.items() if t > used.get(s, 0.0)}
    return out


def window_mixture(placed: DataFrame) -> DataFrame:
    """``(container_kind, shard, window, source, tokens, share)``: the mixture that each window has got."""
    by = placed.groupBy("container_kind", "shard", "window", "source").agg(F.sum("tokens").alias("tokens"))
    return by.withColumn("share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy("container_kind", "shard", "window")))


def _pack(window_containers: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        capacity = int(pdf["capacity"].iloc[0])
        by_source = pdf.drop_duplicates("source").set_index("source")
        ids, tokens, sources = pdf["doc_id"].to_numpy(), pdf["size"].tolist(), pdf["source"].tolist()
        got = pack_shard(ids, tokens, sources, by_source["share"].to_dict(), by_source["owed"].to_dict(), capacity, window_containers)
        row, container, piece, pieces, first, size, window = (np.array(x, dtype=np.int64) for x in zip(*got, strict=True))
        return pd.DataFrame(
            {
                "container_kind": pdf["container_kind"].iloc[0], "capacity": capacity, "shard": pdf["shard"].iloc[0], "container": container, "doc_id": ids[row],
                "source": pdf["source"].to_numpy()[row], "piece": piece.astype("int32"), "pieces": pieces.astype("int32"), "first_token": first, "tokens": size,
                "window": window.astype("int32"),
            }
        )

    return pack


def pack_documents(
    docs: DataFrame, containers: DataFrame, key: str, text: str, source: str, *, kind: str = "container_kind", capacity: str = "capacity", targets: dict[str, float] | None = None,
    window_containers: int = 64, shard_tokens: int = 32_000_000, shard_rows: int = 250_000, max_kinds: int = 100, max_sources: int = 1000,
) -> DataFrame:
    """Every piece of every document with the container that holds it, for each kind of container.

    ``targets`` are the wanted token shares by source; without it those of the documents.  Sources it doesn't name are drawn last.  Shards are
    numbered in order of phases, so that containers in order of shard and number hold the target as long as the corpus can.  NULL
    text is no item; an empty text is an item of one token; NULL source is a queue of its own.  Keys should be unique: rows with the same
    key count once.  Kinds with a NULL name or a capacity below 1 are left out.  At most ``max_kinds`` kinds of container
    and ``max_sources`` sources are packed; more raise an error: sources are to be grouped before.
    """
    spark = docs.sparkSession
    kinds = containers.select(F.col(f"`{kind}`"), F.col(f"`{capacity}`").cast("bigint")).where(f"`{kind}` IS NOT NULL AND `{capacity}` >= 1").distinct().orderBy(kind).limit(max_kinds + 1).collect()
    if len(kinds) > max_kinds:
        raise ValueError(f"more than {max_kinds} kinds of container")
    if not kinds:
        return spark.createDataFrame([], PLACED)
    items = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), byt5_tokens(F.col(f"`{text}`")).alias("size"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("source"))
    items = items.where("doc_id IS NOT NULL AND size IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("size", "source")).alias("x")).select("doc_id", "x.*")
    totals = {r["source"]: (r["t"], r["n"]) for r in items.groupBy("source").agg(F.sum("size").alias("t"), F.count("*").alias("n")).orderBy("source").limit(max_sources + 1).collect()}
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    if not totals:
        return spark.createDataFrame([], PLACED)
    # Where in a source's documents, in order of a hash between 0 and 1, each phase begins, and the numbers of its shards.
    plan, begun, first = [], dict.fromkeys(totals, 0.0), 0
    for number, (shares, used) in enumerate(phases({s: t for s, (t, _) in totals.items()}, targets)):
        n_rows = sum(totals[s][1] * used[s] / totals[s][0] for s in used)
        shards = max(1, -(-int(sum(used.values())) // shard_tokens), -(-int(n_rows) // shard_rows))
        for s, tokens in used.items():
            end = begun[s] + tokens / totals[s][0]
            plan.append((s, number, begun[s], end if end < 1 - 1e-9 else 2.0, shares[s], first, shards))
            begun[s] = end
        first += shards
    parts = spark.createDataFrame(plan, "source string, phase int, since double, until double, share double, first_shard bigint, shards bigint")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    items = items.withColumn("place", place).join(F.broadcast(parts), "source").where("place >= since AND place < until")  # at most max_sources squared rows
    items = items.withColumn("shard", F.col("first_shard") + F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.col("shards"))).select("doc_id", "size", "source", "phase", "shard", "share")
    held = items.groupBy("phase", "shard", "source", "share").agg(F.sum("size").alias("t"))
    # Tokens of earlier shards of the phase; one row per shard and source, far fewer than documents.
    before = held.groupBy("phase", "shard").agg(F.sum("t").alias("all")).withColumn("gone", F.coalesce(F.sum("all").over(Window.partitionBy("phase").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.coalesce(F.sum("t").over(Window.partitionBy("phase", "source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    owed = held.withColumn("own", own).join(before.select("shard", "gone"), "shard").select("shard", "source", (F.col("share") * F.col("gone") - F.col("own")).alias("owed"))
    each = F.explode(F.array(*[F.struct(F.lit(k[0]).alias("container_kind"), F.lit(k[1]).alias("capacity")) for k in kinds]))
    tasks = items.join(owed, ["shard", "source"]).select("*", each.alias("k")).select("doc_id", "size", "source", "shard", "share", "owed", "k.*")
    return tasks.groupBy("container_kind", "shard").applyInPandas(_pack(window_containers), PLACED)
