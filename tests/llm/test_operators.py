"""Each operator against its plain version: on invented edge cases and on the smallest tables."""

import math
import random
import re
from decimal import Decimal

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termlode.llm import formatting, frequencies, leakage, lookalikes, neardup, packing, queries, residue, sql, topn, words
from termlode.llm.distinctive import TermWeights, enrichment, log_factorial, top_terms
from tests.llm import brute, wordings

LONG = "reef " + " ".join(f"word{k}" for k in range(20_000))
TEXTS = [
    (0, "The old café of Zurich"), (1, "The old café of Zurich"), (2, "The old cаfé of Zurich"), (3, "The old café of Ｚuri​ch"), (4, "The old cafe of Zurich"), (5, "The old café  of Zurich"),
    (6, "the old café of zurich"), (7, None), (8, ""), (9, " \t"), (10, "​"), (11, "?! ..."), (12, "name: Ann Lee; port: Rye | year=1900"), (13, "YEAR: 1900\nPort: rye; NAME = ann, lee"), (14, "name ann lee port rye year 1900"),
    (15, "name: Ann; Lee port: Rye | year=1900"), (16, "Тайна йод"), (17, "Тайна йοд"), (18, LONG), (19, LONG.upper() + "."), (20, LONG + " tail"), (21, "The old café of Zurich"), (22, "a a a a a b"),
    (23, "x_y z"), (24, "x y z"), (25, "ofﬁcial １２"), (26, "official 12"), (27, "­"), (21, "The old café of Zurich"), (None, "lost"), (28, "한국어 text"),
]
CLASH = ("rec_id", "text", "form", "term", "n", "words", "bucket", "node", "label", "doc_id", "size", "host")


def frame(spark, rows, kinds="id bigint, t string", clash=True):
    df = spark.createDataFrame(rows, kinds)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH]) if clash else df


@pytest.fixture(scope="module")
def texts(spark):
    return frame(spark, TEXTS)


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def articles(spark, small):
    df = spark.read.parquet(f"{small}/test_tbl_3.parquet")
    return df, [(r["article_id"], r["article_text"]) for r in df.collect()]


def test_records(spark):
    df = frame(spark, [*TEXTS, (40, "b"), (40, "a"), (40, None)])
    for most in (0, 1000):
        got = [tuple(r) for r in words.records(df, "id", "t", most_again=most).collect()]
        assert len(got) == len({k for k, _ in got}) and dict(got) == brute.unique([*TEXTS, (40, "a")])
    assert words.records(df.where("id < 5"), "id", "t").count() == 5 and words.records(df.limit(0), "id", "t").count() == 0


# 1


def test_the_form():
    fold = lookalikes.fold_lookalikes
    for text, form in [
        ("cafе́", "café"), ("Ａｂ：　x", "Ab: x"), ("a​b­c﻿", "abc"), ("a  b", "a  b"), ("Тһе сӏосk", "The clock"), ("Тайна", "Тайна"), ("Γεoδ", "Γεοδ"),
        ("a\tb\r\nc", "a\tb\r\nc"), ("ﬁn", "fin"), ("x‐y", "x-y"), ("²", "²"), ("it’s", "it’s"), (None, None), ("", ""),
    ]:
        assert fold(text) == form
        assert fold(fold(text)) == form


def test_the_form_in_sql():
    texts = [t for _, t in TEXTS if t] + ["Тһе сӏосk ѐё", "ΓεoδΌ x", "a‐b －c", "cafе́ naïve", "ﬂow ﬁn", "１２ａｂ", "Տուն ձ", "Ａｂ：　x"]
    with duckdb.connect() as db:
        for text in texts:
            assert db.execute(f"SELECT {sql.form('x')}, {sql.words(sql.form('x'))} FROM (SELECT ? AS x)", [text]).fetchone() == (lookalikes.fold_lookalikes(text), brute.words(text))


@given(st.text(max_size=40))
def test_the_form_is_stable_and_ignores_composition(text):
    form = lookalikes.fold_lookalikes(text)
    assert lookalikes.fold_lookalikes(form) == form
    assert lookalikes.fold_lookalikes(brute.decomposed(text)) == form
    assert brute.decomposed(lookalikes.map_lookalikes(text)) == brute.decomposed(form)


def test_lookalikes(texts, nothing, articles):
    def pairs(df, k, t):
        got = [tuple(r) for r in lookalikes.Lookalikes(df, k, t).pairs().collect()]
        assert len(got) == len(set(got))
        return set(got)

    assert pairs(texts, "id", "t") == brute.lookalike_pairs(TEXTS) > {(0, 1), (0, 2), (0, 3), (16, 17), (25, 26)}
    assert pairs(nothing, "id", "t") == set()
    assert pairs(articles[0], "article_id", "article_text") == brute.lookalike_pairs(articles[1]) != set()
    rows = lookalikes.Lookalikes(texts, "id", "t").classes().collect()
    classes = {r["rec_id"]: (r["canonical"], r["class_id"], r["links"]) for r in rows}
    assert len(classes) == len(rows) and not {7, 8, 9, 10, 11} & classes.keys()
    assert classes[1] == ("The old café of Zurich", 0, 3) and classes[0] == classes[21] and classes[4] == ("The old cafe of Zurich", 4, 0) and classes[23][1:] == (23, 0)
    assert lookalikes.Lookalikes(nothing, "id", "t").classes().count() == 0


def test_the_collation_decides(spark):
    e, n = "e\u0301", "n\u0303"
    rows = [(0, "Caf\u00e9 ma\u00f1ana"), (1, f"Caf{e} ma{n}ana"), (2, f"Caf{e} ma\u00f1ana"), (3, "Cafe manana"), (4, "Cafe\u0300 ma\u00f1ana"), (5, "caf\u00e9 ma\u00f1ana"), (6, "Caf\u00e9  ma\u00f1ana"), (7, "Caf\u00e9\tma\u00f1ana"), (8, "Caf\u00e9\u00a0ma\u00f1ana"), (9, f"\u0421af{e} ma{n}ana")]
    got = lookalikes.Lookalikes(frame(spark, rows), "id", "t")
    assert {r["rec_id"]: r["class_id"] for r in got.classes().collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 0, 9: 0}
    assert len({lookalikes.map_lookalikes(t) for k, t in rows if k in (0, 1, 2, 8, 9)}) > 1  # the mapping alone doesn't make them equal
    assert {tuple(r) for r in got.pairs().collect()} == brute.lookalike_pairs(rows)


# 2


@pytest.mark.parametrize("options", [{}, {"bucket_rows": 4, "levels": 2}, {"bucket_rows": 2, "levels": 1}])
def test_near_duplicates(texts, nothing, articles, options):
    def pairs(df, k, t):
        got = [tuple(r) for r in neardup.NearDuplicates(df, k, t, 0.7, **options).pairs().collect()]
        assert len(got) == len(set(got))
        return set(got)

    assert pairs(texts, "id", "t") == brute.near_pairs(TEXTS, 0.7)
    assert pairs(nothing, "id", "t") == set()
    assert pairs(articles[0], "article_id", "article_text") == brute.near_pairs(articles[1], 0.7) != set()


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.8, 1.0])
def test_near_duplicates_of_tiny_sets(spark, threshold):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choices("abcdefgh", k=rnd.randint(0, 6)))) for i in range(250)]
    for options in ({"bucket_rows": 3, "levels": 6, "chunk_rows": 40}, {"bucket_rows": 5, "levels": 2}, {}):
        got = {tuple(r) for r in neardup.NearDuplicates(frame(spark, rows), "id", "t", threshold, **options).pairs().collect()}
        assert got == brute.near_pairs(rows, threshold)


def test_near_duplicates_of_long_texts(spark):
    rnd = random.Random(6)
    base = [[f"w{rnd.randint(0, 4000)}" for _ in range(900)] for _ in range(6)]
    rows = [(k, " ".join(w if rnd.random() > k / 400 else f"x{rnd.random()}" for w in base[k % 6])) for k in range(60)]
    near = neardup.NearDuplicates(frame(spark, rows), "id", "t", 0.7)
    assert near.width > 4 and {tuple(r) for r in near.pairs().collect()} == brute.near_pairs(rows, 0.7) != set()


def test_near_duplicate_groups(spark):
    w = [f"w{k}" for k in range(40)]
    chain = [(k, " ".join(w[k : k + 20])) for k in range(12)] + [(20, "other words here"), (21, None), (22, "other words here")]
    got = {r["rec_id"]: (r["group_id"], r["links"]) for r in neardup.NearDuplicates(frame(spark, chain), "id", "t", 0.9).groups().collect()}
    assert {got[k][0] for k in range(12)} == {0} and got[0][1] == 1 and got[5][1] == 2 and got[22] == (20, 0) and 21 not in got
    with pytest.raises(ValueError):
        neardup.NearDuplicates(frame(spark, chain), "id", "t", 0)


def test_trees_prune_at_inner_nodes(spark, small):
    df = spark.read.parquet(f"{small.replace('0.001', '0.1')}/test_tbl_3.parquet")
    near = neardup.NearDuplicates(df, "article_id", "article_text", 0.7)
    rows = near.buckets(10_000, 6)
    key = rows.groupBy("bucket").count().orderBy(F.desc("count")).first()
    got = rows.where(F.col("bucket") == key["bucket"]).orderBy("side", "n", "s").toPandas()
    tested: list = []
    bits = np.stack([got[b].to_numpy() for b in neardup.bit_names(near.width)], axis=1).view(np.uint64)
    list(neardup.dual_traversal(got["bucket"].to_numpy(), got["side"].to_numpy(), got["n"].to_numpy(), got["s"].to_numpy(), bits, 0.7, tested=tested))
    by = {h: (sum(t for x, t, _ in tested if x == h), sum(k for x, _, k in tested if x == h)) for h, _, _ in tested}
    assert by[1][1] < 0.5 * by[1][0] and by[0][0] < 0.25 * key["count"] ** 2 / 2


def test_many_copies_and_small_edits(spark):
    rows = [(k, "one two three four five six seven eight nine ten") for k in range(60)] + [(60 + k, f"one two three four five six seven eight nine ten {k}") for k in range(60)]
    assert {tuple(r) for r in neardup.NearDuplicates(frame(spark, rows), "id", "t", 0.7, bucket_rows=8, levels=3).pairs().collect()} == brute.near_pairs(rows, 0.7)


# 3


def test_formatting(texts, nothing, articles):
    def classes(df, k, t):
        rows = formatting.formatting_classes(df, k, t).collect()
        assert len(rows) == len({r["rec_id"] for r in rows})
        return {r["rec_id"]: r["keep_id"] for r in rows}

    got = classes(texts, "id", "t")
    assert got == brute.formatting(TEXTS) and got[6] == 0 and got[12] == got[13] == got[14] == got[15] == 12 and got[19] == 18 and got[24] == 23
    assert classes(nothing, "id", "t") == {}
    assert classes(articles[0], "article_id", "article_text") == brute.formatting(articles[1]) != {}
    kept = {r["rec_id"]: r["copies"] for r in formatting.collapse_formatting(texts, "id", "t").collect()}
    assert kept[12] == 4 and kept[7] == 1 and 13 not in kept and sum(kept.values()) == 29


def test_colliding_hashes_are_told_apart(spark, monkeypatch):
    rows = [(0, "a b"), (1, "A, b"), (2, "c d"), (3, "c-d"), (4, "e"), (5, "E!"), (6, "k: v; l: w"), (7, "L=W|K=V"), (8, "k: w; l: v")]
    plain = formatting.hash_texts

    def clumsy(batches):
        import pyarrow as pa

        for b in batches:
            words, size, fields = plain(b.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(words.astype(np.int64) * 0), pa.array(size * 0), pa.array((fields != 0).astype(np.int64))], names=["rec_id", "h1", "h2", "words", "size", "fields"])

    monkeypatch.setattr(formatting, "_hash_batches", clumsy)
    got = {r["rec_id"]: r["keep_id"] for r in formatting.formatting_classes(frame(spark, rows), "id", "t").collect()}
    assert {k: v for k, v in got.items() if k != v} == {1: 0, 3: 2, 5: 4, 7: 6}


@settings(deadline=None)
@given(st.text(alphabet="aAbB1 ,-;:=|\n", max_size=14), st.text(alphabet="aAbB1 ,-;:=|\n", max_size=14))
def test_hashes_and_proofs_agree_with_the_statement(a, b):
    words, size, fields = formatting.hash_texts([a, b])
    equal = brute.words(a) == brute.words(b)
    assert formatting.same_words(a, b) == equal == ((words[0], size[0]) == (words[1], size[1]))
    if brute.fields(a) and brute.fields(b):
        assert formatting.same_fields(a, b) == (brute.fields(a) == brute.fields(b)) == (fields[0] == fields[1])


# 4


@settings(max_examples=60)
@given(st.integers(1, 60), st.integers(1, 60), st.integers(1, 12))
def test_exact_tail(length, held, f):
    total, f = 120, min(f, length, held)
    assert enrichment(np.array([f]), np.array([length]), np.array([held]), total)[0] == pytest.approx(-math.log10(brute.tail(f, length, held, total)), abs=1e-9)


@pytest.mark.parametrize("total", [60, 5000, 10**7, 10**11, 10**13])
def test_the_tail_keeps_its_digits_in_any_collection(total):
    rnd = random.Random(total)
    for _ in range(25):
        length, held = rnd.randint(1, min(300, total)), rnd.choice([rnd.randint(1, min(total, 60)), rnd.randint(1, total // 2)])
        f = rnd.randint(1, min(length, held, 9))
        p = part = Decimal(math.comb(held, f) * math.comb(total - held, length - f)) / Decimal(math.comb(total, length))
        for k in range(f, min(held, length)):
            part = part * (held - k) * (length - k) / ((k + 1) * max(total - held - length + k + 1, 1))
            p += part
        got = enrichment(np.array([f]), np.array([length]), np.array([held]), float(total))[0]
        assert p == 0 or got == pytest.approx(max(0.0, float(-p.log10())), abs=1e-9)


def test_log_factorial():
    for x in (0, 1, 2, 170, 4095, 4096, 10**6, 10**12):
        assert log_factorial(np.array([x]))[0] == pytest.approx(math.lgamma(x + 1), rel=1e-13, abs=1e-13)
    assert enrichment(np.array([3, 0]), np.array([5, 5]), np.array([0, 2]), 100).tolist() == [0.0, 0.0]


@pytest.mark.parametrize(("parts", "leaf_rows"), [(20_000, 1_000_000), (3, 100)])
def test_distinctive(texts, nothing, articles, parts, leaf_rows, monkeypatch):
    monkeypatch.setattr("termlode.llm.distinctive.HEAVY_PARTS", parts)
    for df, rows, k, t in ((texts, TEXTS, "id", "t"), (*articles, "article_id", "article_text")):
        weights = TermWeights(df, k, t, leaf_rows=leaf_rows)
        scored = weights.score(df, k, t).collect()
        assert {(r["rec_id"], r["term"]): r["weight"] for r in scored} == pytest.approx(brute.weights(rows, rows), abs=2e-6)
        assert len(scored) == len({(r["rec_id"], r["term"]) for r in scored})
        full = {(r["rec_id"], r["rank"], r["term"]) for r in top_terms(weights.score(df, k, t), "weight", 3).collect()}
        assert full == {(r["rec_id"], r["rank"], r["term"]) for r in top_terms(weights.score(df, k, t, ("weight",), top=3), "weight", 3).collect()} != set()
    assert TermWeights(nothing, "id", "t").score(texts, "id", "t").where("weight != 0").count() == 0
    assert weights.score(nothing, "id", "t").count() == 0


def test_adjusted_scores(texts):
    rows = TermWeights(texts, "id", "t").adjusted(texts, "id", "t").where("rec_id = 22").orderBy(F.desc("score"), "term").collect()
    p = [10 ** -r["score"] for r in rows]
    q = [min(p[j] * len(p) / (j + 1) for j in range(i, len(p))) for i in range(len(p))]
    assert [10 ** -r["q_score"] for r in rows] == pytest.approx([min(x, 1.0) for x in q])


# 5


@pytest.mark.parametrize("radix", [{}, {"bits": 4, "leaf_rows": 1500}, {"bits": 16, "leaf_rows": 1}])
def test_frequencies(texts, nothing, articles, radix):
    for df, rows, k, t in ((texts, TEXTS, "id", "t"), (*articles, "article_id", "article_text"))[:: 1 if not radix or radix["bits"] == 4 else 2]:
        if radix.get("bits") == 16:
            df, rows = df.where("id < 18"), [r for r in TEXTS if r[0] is not None and r[0] < 18]
        got = frequencies.term_frequencies(df, k, t, **radix).collect()
        assert len(got) == len({r["term"] for r in got})
        assert {r["term"]: (r["occurrences"], r["records"]) for r in got} == brute.frequencies(rows)
        n = sum(bool(brute.words(x)) for x in brute.unique(rows).values())
        assert all(r["mark"] == ("rare" if r["records"] < 3 else "common" if r["records"] > 0.1 * n else None) for r in got)
    assert frequencies.term_frequencies(nothing, "id", "t").count() == 0


def _partitions(folder):
    """Rows of each radix folder of a level."""
    return {d.name: sum(pq.ParquetFile(f).metadata.num_rows for f in d.glob("*.parquet")) for d in folder.iterdir() if d.name.startswith("radix=")}


@pytest.mark.parametrize(("leaf_rows", "levels"), [(40, 2), (150, 2), (5000, 1)])
def test_radix_partitions_shrink_and_are_counted_once(articles, leaf_rows, levels, monkeypatch, tmp_path):
    written = []
    monkeypatch.setattr(frequencies, "scratch_path", lambda spark, name: written.append(tmp_path / f"{name}-{len(written)}") or f"file://{written[-1]}")
    df, rows = articles
    terms = brute.frequencies(rows)
    got = frequencies.count_terms(df, "article_id", "article_text", bits=3, leaf_rows=leaf_rows).collect()
    assert len(got) == len(terms) + 1 == len({r["term"] for r in got})  # one row more for the totals
    assert {r["term"]: (r["occurrences"], r["records"]) for r in got if r["term"]} == terms
    found = [_partitions(w) for w in written if w.name.startswith("radix")]
    assert len(found) == levels
    for above, below in zip(found, found[1:], strict=False):
        over = {int(name.partition("=")[2]) for name, n in above.items() if n > leaf_rows}
        # Only what is oversized goes down, each parent's children apart.
        assert {int(name.partition("=")[2]) >> 3 for name in below} == over and sum(below.values()) <= sum(n for n in above.values() if n > leaf_rows)
    assert max(found[-1].values()) <= leaf_rows
    marked = frequencies.term_frequencies(df, "article_id", "article_text", bits=3, leaf_rows=leaf_rows).collect()
    assert len(marked) == len(terms)


def test_one_hot_term_ends(spark):
    df = frame(spark, [(k, "reef") for k in range(400)]).repartition(40)
    got = {r["term"]: (r["occurrences"], r["records"]) for r in frequencies.count_terms(df, "id", "t", bits=16, leaf_rows=1).collect()}
    assert got == {"": (400, 400), "reef": (400, 400)}


def test_leaves_never_spill_beside_the_shared_folder():
    for spill in ("", "/mnt/shared/leaf"):
        with duckdb.connect(config=frequencies.leaf_options("64MB", spill)) as db:
            assert db.execute("SELECT current_setting('temp_directory')").fetchone() == (spill,)
    assert frequencies._tasks([("a", 3), ("b", 3), ("c", 9)], 6, 1) == [["a", "b"], ["c"]]


# 6

SCORES = [(1, k % 7, k % 11, float(k % 5)) for k in range(300)] + [
    (1, 1, 5, None), (1, 1, 6, math.nan), (1, None, 6, 1.0), (None, 1, 6, 1.0), (1, 1, None, 1.0), (2, 1, 9, -0.0), (2, 1, 3, 0.0), (2, 1, 4, -1.0), (2, 2, 7, 0.5), (2, 2, 7, 0.7), (2, 2, 8, 0.7), (2, 2, 8, 0.1), (3, 1, 2, math.nan), (4, 1, 2, math.inf), (4, 1, 1, -math.inf),
]


@pytest.mark.parametrize("options", [{}, {"run_rows": 7, "bucket_rows": 150}, {"run_rows": 1, "bucket_rows": 1000}, {"run_rows": 5, "fan_in": 3, "bucket_rows": 80}])
@pytest.mark.parametrize("n", [1, 3, 10])
def test_top_n(spark, n, options):
    kinds = "a int, b int, i bigint, s double, score string, item string, g1 int, bucket int"
    df = spark.createDataFrame([(*r, "x", "y", 0, 0) for r in SCORES], kinds).repartition(5).sortWithinPartitions("s")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = topn.top_n(df, ("a", "b"), "i", "s", n, **options).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = [(r["g1"], r["g2"], r["item"], r["rank"]) for r in got]
    assert len(rows) == len(set(rows)) and set(rows) == brute.best(SCORES, n)
    assert topn.top_n(df.limit(0), ("a", "b"), "i", "s", n).count() == 0


@given(st.lists(st.lists(st.integers(0, 30), max_size=8), max_size=9))
def test_loser_tree(runs):
    runs = [sorted(r) for r in runs]
    at = [0] * len(runs)
    head = lambda k: (runs[k][at[k]],) if at[k] < len(runs[k]) else None
    tree, out = topn.LoserTree([head(k) for k in range(len(runs))]), []
    while tree.heads[tree.winner] is not None:
        out.append(tree.heads[tree.winner][0])
        at[tree.winner] += 1
        tree.replace(head(tree.winner))
    assert out == sorted(x for r in runs for x in r)


# 7


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.sampled_from("abc")), min_size=1, max_size=60), st.integers(1, 25), st.integers(1, 4), st.floats(-200, 200))
def test_packing_a_shard(items, capacity, window, owed):
    sizes, sources = [x[0] for x in items], [x[1] for x in items]
    shares = {s: sum(n for n, o in items if o == s) / sum(sizes) for s in set(sources)}
    out = packing.pack_shard(np.arange(len(items)), sizes, sources, shares, {"a": owed}, capacity, window)
    held: dict = {}
    for row, container, piece, pieces, first, tokens, _ in out:
        held[container] = held.get(container, 0) + tokens
        assert (pieces > 1) == (sizes[row] > capacity) and first == (piece - 1) * capacity
    assert max(held.values()) <= capacity
    for row, size in enumerate(sizes):
        parts = sorted((p[4], p[5]) for p in out if p[0] == row)
        assert sum(t for _, t in parts) == size and all(a + t == b for (a, t), (b, _) in zip(parts, parts[1:], strict=False))


def test_packing(spark, small):
    docs, kinds = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/containers.parquet")
    for shard_rows in (250_000, 9):
        placed = packing.pack_documents(docs, kinds, "doc_id", "text", "source", shard_rows=shard_rows).toPandas()
        sizes = {r["doc_id"]: len(r["text"].encode()) + 1 for r in docs.collect() if r["text"] is not None}
        for _, g in placed.groupby("container_kind"):
            assert g.groupby("doc_id").tokens.sum().to_dict() == sizes
            assert (g.groupby(["shard", "container"]).tokens.sum() <= g.capacity.iloc[0]).all()
    full = packing.pack_documents(spark.read.parquet(small.replace("0.001", "0.01") + "/documents.parquet"), kinds, "doc_id", "text", "source").where("capacity = 2048").toPandas()
    assert full.tokens.sum() / (full.container.nunique() * 2048) > 0.97


def test_packing_edges(spark):
    docs = spark.createDataFrame([(1, "x" * 30, None, 1), (2, None, "a", 1), (3, "", "b", 1), (3, "", "b", 1), (None, "q", "b", 1), (4, "é" * 4, "a", 1)], "doc_id bigint, text string, source string, capacity int")
    kinds = spark.createDataFrame([("k", 10), ("k", 10), (None, 5), ("z", 0), ("n", None)], "container_kind string, capacity bigint")
    got = packing.pack_documents(docs, kinds, "doc_id", "text", "source", targets={"a": 3, "b": 1}).orderBy("doc_id", "piece").collect()
    assert [(r["doc_id"], r["piece"], r["pieces"], r["tokens"]) for r in got] == [(1, 1, 4, 10), (1, 2, 4, 10), (1, 3, 4, 10), (1, 4, 4, 1), (3, 1, 1, 1), (4, 1, 1, 9)]
    assert packing.pack_documents(docs.limit(0), kinds, "doc_id", "text", "source").count() == 0 == packing.pack_documents(docs, kinds.limit(0), "doc_id", "text", "source").count()


def test_windows_keep_the_mixture():
    rnd = random.Random(1)
    items = [(rnd.randint(5, 40), "a") for _ in range(3000)] + [(rnd.randint(5, 40), "b") for _ in range(1000)]
    out = packing.pack_shard(np.arange(4000), [x[0] for x in items], [x[1] for x in items], {"a": 0.75, "b": 0.25}, {}, 100, 20)
    by: dict = {}
    for row, _, _, _, _, tokens, window in out:
        by.setdefault(window, {"a": 0, "b": 0})[items[row][1]] += tokens
    for w in range(len(by) - 2):
        assert 0.70 < by[w]["a"] / (by[w]["a"] + by[w]["b"]) < 0.80


def test_phases():
    assert packing.phases({"a": 300, "b": 100}, None) == [({"a": 0.75, "b": 0.25}, {"a": 300.0, "b": 100.0})]
    got = packing.phases({"a": 300, "b": 100, "c": 50, "d": 0}, {"a": 1, "b": 1})
    assert got == [({"a": 0.5, "b": 0.5}, {"a": 100.0, "b": 100.0}), ({"a": 1.0}, {"a": 200.0}), ({"c": 1.0}, {"c": 50.0})]


@pytest.mark.parametrize("targets", [{"a": 1.0, "b": 1.0}, {"a": 1.0, "b": 3.0, "c": 0.5}, None])
def test_windows_hold_targets_unlike_the_corpus(spark, targets):
    rnd = random.Random(7)
    docs = spark.createDataFrame([(k, "x" * rnd.randint(5, 60), "a" if k % 4 else "b") for k in range(12_000)], "doc_id bigint, text string, source string")
    kinds = spark.createDataFrame([("k", 100)], "container_kind string, capacity bigint")
    placed = packing.pack_documents(docs, kinds, "doc_id", "text", "source", targets=targets, window_containers=40, shard_tokens=120_000).cache()
    sizes = {r["doc_id"]: len(r["text"]) + 1 for r in docs.collect()}
    rows = placed.toPandas()
    assert rows.groupby("doc_id").tokens.sum().to_dict() == sizes and (rows.groupby(["shard", "container"]).tokens.sum() <= 100).all()
    totals = {s: int(sum(n for k, n in sizes.items() if (k % 4 > 0) == (s == "a"))) for s in "ab"}
    first = packing.phases(totals, targets)[0]
    mixture = packing.window_mixture(placed).toPandas()
    on_target = mixture[(mixture.source == "b") & (abs(mixture.share - first[0]["b"]) < 0.12)].merge(mixture.groupby(["shard", "window"]).tokens.sum().rename("all"), on=["shard", "window"])["all"].sum()
    assert on_target > 0.9 * sum(first[1].values())  # what the corpus can give on target


# 8


def test_shared_runs(spark, small):
    docs, items = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/eval_items.parquet")
    index = leakage.LeakageIndex(docs, "doc_id", "text", items, "item_id", "item_text", "answer")
    truth = brute.shared_runs([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["item_text"]) for r in items.collect()], 10)
    got = [(r["doc_id"], r["item_id"]) for r in index.shared_runs(10).collect()]
    assert len(got) == len(set(got)) and set(got) == truth != set()


def test_leak_edges(spark):
    rnd = random.Random(2)
    vocabulary = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(rnd.choices(vocabulary, k=25)), rnd.choice([None, "w1 w2"])) for k in range(12)] + [(90, None, "x"), (91, "", None), (92, "short one", None), (None, "w1 " * 12, None)]
    items += [(93, items[0][1].upper().replace(" ", ", "), None)]
    docs = [(k, " ".join(rnd.choices([*vocabulary, "zz"], k=40)) + " " + " ".join(items[k % 12][1].split()[a : a + n])) for k in range(60) for a, n in [(rnd.randint(0, 12), rnd.randint(7, 13))]]
    docs += [(70, None), (71, ""), (72, "w1 w2"), (None, items[0][1]), (73, "zz " * 30_000 + items[1][1]), (0, docs[0][1])]
    d, i = frame(spark, docs), spark.createDataFrame(items, "k bigint, q string, a string").select("*", F.lit("x").alias("text"), F.lit(1).alias("item_id"))
    index = leakage.LeakageIndex(d, "id", "t", i, "k", "q", "a")
    truth = brute.shared_runs(docs, [x[:2] for x in items], 10)
    assert {(r["doc_id"], r["item_id"]) for r in index.shared_runs(10).collect()} == truth != set()
    assert {r["run"] for r in index.shared_runs(10).where("doc_id = 73 AND item_id = 1").collect()} == {25}
    assert (73, 1) in {(r["doc_id"], r["item_id"]) for r in index.paraphrases().collect()}
    assert leakage.LeakageIndex(d.limit(0), "id", "t", i, "k", "q").shared_runs().count() == 0
    empty = leakage.LeakageIndex(d, "id", "t", i.limit(0), "k", "q")
    assert empty.shared_runs().count() == 0 == empty.paraphrases().count()
    with pytest.raises(ValueError):
        leakage.LeakageIndex(d, "id", "t", i, "k", "q", max_items=3)


def test_short_texts_are_searched_for_paraphrases(spark):
    items = [(1, "tall keel of dark oak", "oak"), (2, " ".join(f"k{j}" for j in range(40)), None)]
    docs = [(10, "tall keel of dark oak"), (11, "they saw a tall keel of dark oak and left in haste for the far side of the wide bay"), (12, "oak dark of keel tall"), (13, " ".join(f"k{j}" for j in range(3, 17))), (14, "nothing of note")]
    rng = random.Random(3)
    docs += [(20 + k, " ".join(rng.choices([f"k{j}" for j in range(40)] + ["tall", "keel", "oak", "dark", "x"], k=30))) for k in range(40)]
    index = leakage.LeakageIndex(frame(spark, docs), "id", "t", spark.createDataFrame(items, "k bigint, q string, a string"), "k", "q", "a")
    got = {(r["doc_id"], r["item_id"]): r["has_answer"] for r in index.paraphrases(cosine=0.8).collect()}
    assert {(10, 1), (11, 1), (13, 2)} <= got.keys() and (12, 1) not in got and (14, 1) not in got and got[(10, 1)]


def test_cells_lose_nothing():
    rng = np.random.default_rng(1)
    unit, mine = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (rng.standard_normal((500, 6)), rng.standard_normal((300, 6))))
    for cosine in (0.6, 0.9):
        a, b, c = leakage._near(mine, unit, leakage._cells(unit), cosine)
        assert set(zip(a.tolist(), b.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(mine @ unit.T >= cosine)), strict=True)) and (c >= cosine).all()


def test_equal_passages_have_equal_vectors():
    rng = np.random.default_rng(2)
    table = np.column_stack([rng.standard_normal((50, 4)) * np.r_[np.ones(25), np.full(25, 1e-11)][:, None], rng.uniform(0.5, 1, 50) * 1e-3])
    run = rng.integers(25, 50, 10)
    codes = np.r_[rng.integers(0, 50, 3000), run, rng.integers(0, 50, 20)].astype(np.int32)
    alone = leakage._latent(table, run.astype(np.int32), np.array([0]), np.array([10]))
    assert (leakage._latent(table, codes, np.array([3000]), np.array([10])) == alone).all()


def test_longest_common_subsequences():
    a, b = np.array([[1, 2, 3, -1, 4], [5, 5, -1, -1, 5]]), np.array([[2, 9, 3, 4], [5, 6, 5, 7]])
    assert leakage.longest_common_subsequences(a, b).tolist() == [3, 2]


# 9

ARTICLE = "The harbour of Zurgim sold the old lantern in 1904, and sailors praised the narrow treaty before the winter."
RESIDUE = [
    "The {{title}} of Zurgim sold the lantern.", "About ${date} sailors live there.", "The [INSERT NAME HERE] of Zurgim.", "The [object Object] sold it.", "It cost NaN crowns.", "Built in #REF! by sailors.", "The undefined of Zurgim sold it.",
    "Lorem ipsum dolor sit amet velit esse culpa.", "404 Not Found\nThe page you asked for does not exist.", "Menu  Search  Sign in\nPlease enable JavaScript to read this article.", "Content goes here. Content goes here.", "Service unavailable. Please try again in 4 minutes.", "foo bar foo bar foo bar foo bar",
    "Página não encontrada (404). O endereço pode ter mudado.", "Bitte aktivieren Sie JavaScript, um den Artikel zu lesen.", "xxxx xxxx xxxx", "A %s called on the %(city)s.", "The *|NAME|* sold the __title__.",
]
FINE = [
    ARTICLE, ARTICLE + "\n\nTo leave a comment, enable JavaScript in your browser.", ARTICLE + ' The manual explains that a page maker writes "${title}" for it.', ARTICLE + " The undefined border between both parishes caused a dispute.",
    ARTICLE + " The printers filled empty columns with lorem ipsum for a week.", ARTICLE + " The annotator added {good try} and [sic] beside the move 14.Rd1, then a plain {draw}.", "A short note.", "12", None, "", " \n", "Sold at 50% off, she said, for $5 and $7.",
]


@pytest.mark.parametrize("text", RESIDUE)
def test_residue(text):
    assert residue.is_residue(text) and residue.is_residue(text.upper() if "NaN" not in text and "%s" not in text else text)


@pytest.mark.parametrize("text", FINE)
def test_no_residue(text):
    assert not residue.is_residue(text)


@pytest.mark.parametrize("text", ["Erro 404", "Fehler 500", "Fehlercode: 3\nFehlercode 17", "HTTP erro 503", "This page needs a JavaScript-enabled viewer.", "Without-cookies reading: cookies’ support is off", "12 internals", "JavaScrıpt is disabled"])
def test_residue_without_a_plain_key(text):
    assert residue.is_residue(text) and residue.is_residue(text.upper())


@pytest.mark.parametrize("pattern", residue._EVIDENCE)
@settings(max_examples=25, deadline=None)
@given(data=st.data())
def test_no_evidence_is_skipped(pattern, data):
    sentence = residue.normal_line(data.draw(st.from_regex(re.compile(pattern, re.IGNORECASE))))
    assert residue.has_evidence(sentence, residue._TOKEN.findall(sentence)) == bool(residue.EVIDENCE.search(sentence))


def test_residue_by_host(spark, nothing):
    frame_line = "The whole archive of all the letters and papers is open to members of the club on every market day of the year"[:78]
    rows = [(k, f"{ARTICLE} {k}\n{frame_line}", "h") for k in range(6)] + [(20, f"{frame_line}\nPlease enable JavaScript to go on.", "h"), (21, f"{frame_line}\nPlease enable JavaScript to go on.", "other"), (22, None, "h"), (23, "", None), (None, "Lorem ipsum dolor sit", "h"), (24, "Lorem ipsum dolor sit", None), (24, "Lorem ipsum dolor sit", None)]
    df = spark.createDataFrame(rows, "id bigint, t string, h string").select("*", *[F.lit("clash").alias(c) for c in ("doc_id", "text", "host", "line", "frame", "n")])
    assert sorted(r["doc_id"] for r in residue.template_residue(df, "id", "t", "h").collect()) == [20, 24]
    copies = spark.createDataFrame([(k, f"{ARTICLE}\nPlease enable JavaScript to comment.", "h") for k in range(30)], "id bigint, t string, h string")
    assert residue.template_residue(copies, "id", "t", "h").count() == 0
    assert residue.template_residue(nothing, "id", "t", "form").count() == 0


@pytest.mark.parametrize("text", ["The «title» of Zurgim sold the lantern.", "The « Name » of Zurgim.", "The ( insert name ) of Zurgim.", "The ( Your\tname here) of Zurgim.", "The &Lt;name&gt; sold it.", "The UnDefined of Zurgim sold it."])
def test_slots_behind_hints(text):
    assert residue.has_slot(text) and residue.is_residue(text)


@pytest.mark.parametrize("text", ["They call it «the old lantern» here.", 'The manual writes "«title»" for it.', "The manual writes «a ${title} of yours» for it.", "The sailors (your old friends of the harbour, as they said in the long winter) left."])
def test_quoted_slots_are_none(text):
    assert not residue.has_slot(text)


@pytest.mark.parametrize("text", ["The sailors crossed TBD_TBD narrow reefs.", "The Dear [Recipient] of Zurgim.", "SOLD TO FIRST_NAME AT DAWN.", "The TODO of Zurgim.", "{{" + "long " * 20 + "name}}"])
def test_more_slots(text):
    assert residue.has_slot(text)


@pytest.mark.parametrize("text", ["The treaty [1] and the answer [23] stand.", "Where a[name] is read.", "THE ANNOTATOR ADDED {GOOD TRY} AND [SIC] BESIDE THE MOVE.", "TODO O DIA NO PORTO.", "The {draw} came late.", "The harbour [captain] sold it."])
def test_remarks_are_no_slots(text):
    assert not residue.has_slot(text)


def test_held_out_wordings():
    """What is measured here stands in the README: single messages of unknown wording are mostly missed, short articles mostly left alone."""
    found, wrong = (sum(map(residue.is_residue, x)) for x in (wordings.BAD, wordings.GOOD))
    assert found / len(wordings.BAD) >= 0.3 and found / (found + wrong) >= 0.9


def test_what_a_collection_teaches(spark):
    """Fields from unmistakable slots, and messages of any wording that recur over hosts."""
    own = [f"{ARTICLE} {a}{b} came {k}." for k, (a, b) in enumerate((a, b) for a in "abcdefgh" for b in "klmn")]
    rows = [(k, t, f"h{k % 4}") for k, t in enumerate(own)]
    rows += [(100 + k, f"The {{{{keel}}}} of ship {k} sank in the deep blue winter of the year.", "h0") for k in range(3)] + [(110, "The {keel} of the old ship sank in the deep blue winter of the year.", "h1"), (111, "The {mast} of the old ship sank in the deep blue winter of the year.", "h1")]
    rows += [(200 + k, f"Whoops, the reef is gone from our shelves. Incident {k}a{k}.", f"h{k % 3}") for k in range(12)] + [(300, own[0] + " Whoops, the reef is gone from our shelves.", "h1"), (301, "Whoops, the reef is far off today.", "h1")]
    df = spark.createDataFrame(rows, "id bigint, t string, h string")
    for most in (0, 1000):
        got = {r["doc_id"] for r in residue.template_residue(df, "id", "t", "h", most_frame=most).collect()}
        assert got == {100, 101, 102, 110, *range(200, 212)}


def test_long_lines_are_frame(spark):
    notice = "This site and its partners keep small files on your device to measure visits, to remember choices and to show offers that suit the reader, as the law of the land allows."
    broken = "Please enable JavaScript to go on, " + "as this archive of letters and papers opens its rooms in no other way to any reader, " * 2
    rows = [(k, f"{ARTICLE.replace('lantern', 'ship' + 'abcdefgh'[k])}\n{notice}\n{broken}", "h") for k in range(6)] + [(20, f"404 Not Found\n{notice}", "h"), (21, f"404 Not Found\n{notice}", "other"), (22, broken + "\n" + notice, "h")]
    df = spark.createDataFrame(rows, "id bigint, t string, h string")
    assert sorted(r["doc_id"] for r in residue.template_residue(df, "id", "t", "h").collect()) == [20, 22]


# queries


@pytest.mark.parametrize("name", queries.queries())
def test_query_runs(spark, small, name):
    assert queries.queries()[name](spark, small).count() > 0


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_sql(spark, small, name):
    with duckdb.connect() as db:
        for t in ("docsim", "documents", "containers", "eval_items", "test_tbl_3", "queries"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
        got = db.execute(queries.oracle_sql()[name])
        names, rows = [c[0] for c in got.description], got.fetchall()
    df = queries.queries()[name](spark, small).select(*names)
    assert sorted((tuple(r) for r in df.collect()), key=repr) == sorted(rows, key=repr)
