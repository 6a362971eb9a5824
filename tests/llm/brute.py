"""Plain single-process versions of the training-data problems, written from their statements."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict

from termlode.llm.lookalikes import fold_lookalikes

WORD = re.compile(r"[^\W_]+")


def words(text):
    return [w.lower() for w in WORD.findall(fold_lookalikes(text) or "")] if text else []


def unique(rows):
    """One text per key: the least that is not NULL."""
    out: dict = {}
    for k, t in rows:
        if k is not None and (k not in out or (t is not None and (out[k] is None or t < out[k]))):
            out[k] = t
    return out


def lookalike_pairs(rows):
    groups = defaultdict(list)
    for k, t in unique(rows).items():
        if words(t):
            groups[fold_lookalikes(t)].append((k, t))
    return {tuple(sorted((a, b))) for g in groups.values() for a, x in g for b, y in g if a < b and x != y}


def near_pairs(rows, threshold):
    sets = {k: set(words(t)) for k, t in unique(rows).items() if words(t)}
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12}


def fields(form):
    if not any(c in form for c in ";|:="):
        return None
    out = set()
    for part in re.split(r"[;|\r\n]", form):
        m = re.search("[:=]", part)
        label, value = (part[: m.start()], part[m.end() :]) if m else (part, "")
        if words(part):
            out.add((tuple(words(label)), tuple(words(value))))
    return frozenset(out)


def formatting(rows):
    """{key: least key of its class} for classes of two or more."""
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    keys = []
    for k, t in unique(rows).items():
        if words(t):
            keys.append(k)
            parent[find(("id", k))] = find(("words", tuple(words(t))))
            f = fields(fold_lookalikes(t))
            if f is not None:
                parent[find(("id", k))] = find(("fields", f))
    classes = defaultdict(list)
    for k in keys:
        classes[find(("id", k))].append(k)
    return {k: min(c) for c in classes.values() if len(c) > 1 for k in c}


def frequencies(rows):
    total, held = Counter(), Counter()
    for t in unique(rows).values():
        total.update(words(t))
        held.update(set(words(t)))
    return {t: (total[t], held[t]) for t in total}


def weights(rows, collection):
    held = Counter(w for t in unique(collection).values() for w in set(words(t)))
    n = sum(bool(words(t)) for t in unique(collection).values())
    return {(k, w): round((1 + math.log2(f)) * math.log2(n / held[w]), 6) if held[w] else 0.0 for k, t in unique(rows).items() for w, f in Counter(words(t)).items()}


def tail(f, length, held, total):
    """Upper tail of the hypergeometric distribution in whole numbers."""
    ways = sum(math.comb(held, k) * math.comb(total - held, length - k) for k in range(f, min(held, length) + 1))
    return ways / math.comb(total, length)


def best(rows, n):
    groups = defaultdict(dict)
    for a, b, item, score in rows:
        if None not in (a, b, item, score) and not math.isnan(score):
            groups[a, b][item] = max(score, groups[a, b].get(item, -math.inf))
    return {(*g, item, r) for g, held in groups.items() for r, (item, _) in enumerate(sorted(held.items(), key=lambda x: (-x[1], x[0]))[:n], 1)}


def shared_runs(docs, items, n):
    grams = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(len(w) - n + 1):
            grams[tuple(w[k : k + n])].add(i)
    return {(d, i) for d, t in docs if d is not None for w in [words(t)] for k in range(len(w) - n + 1) for i in grams.get(tuple(w[k : k + n]), ()) if i is not None}


def decomposed(text):
    return unicodedata.normalize("NFD", text)
