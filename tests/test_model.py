import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from termlode.operators import reports, search
from termlode.operators.model import TextOptions, build_model, count_terms, with_stopwords
from termlode.sources.store import ModelStore

CHESS = ["pawn knight chess pieces knight best game", "move involves rook pawn king", "pawn lassoed ox", "rodeo horse", "police officers threw jail"]
RANKINGS = {
    "pawn knight rook king": (4.088663, [(1, 0.589126), (0, 0.419157), (2, 0.039471), (3, 0), (4, 0)]),
    "knight move chess": (4.021697, [(0, 0.608553), (1, 0.285107), (2, 0), (3, 0), (4, 0)]),
    "rook king move": (4.021697, [(1, 0.855322), (0, 0), (2, 0), (3, 0), (4, 0)]),
    "rodeo horse ox": (4.021697, [(3, 0.816497), (2, 0.398339), (0, 0), (1, 0), (4, 0)]),
    "pawn police jail move": (4.088663, [(4, 0.567894), (1, 0.308689), (2, 0.039471), (0, 0.020100), (3, 0)]),
}


def corpus(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "article_id bigint, article_text string")


@pytest.fixture(scope="module")
def chess(spark):
    return build_model(corpus(spark, CHESS), "article_id", "article_text", materialise="weights")


def ranked(model, text, k=10):
    rows = search.search_many(model, search.query_frame(model, {1: text}), k).orderBy("rank").collect()
    return [(r["doc_id"], r["similarity"]) for r in rows]


def test_norms_by_hand(chess):
    got = {r["doc_id"]: round(r["norm"], 6) for r in chess.doc_norms.collect()}
    assert got == {0: 6.608625, 1: 4.701970, 2: 3.365385, 3: 3.283702, 4: 4.643856}


@pytest.mark.parametrize("query", RANKINGS)
def test_rankings_by_hand(chess, query):
    norm, order = RANKINGS[query]
    asked = search.query_frame(chess, {1: query})
    assert round(search.query_norms(asked, search.query_vectors(chess, asked)).first()["norm"], 6) == norm
    assert ranked(chess, query) == [(d, pytest.approx(s, abs=1e-6)) for d, s in order]


def test_k(chess):
    assert ranked(chess, "pawn", 0) == [] == ranked(chess, "pawn", -3)
    assert len(ranked(chess, "pawn", 2)) == 2 and len(ranked(chess, "pawn", 99)) == 5
    assert ranked(chess, "of the and") == ranked(chess, "unheard") == [(k, 0.0) for k in range(5)]


def test_edges(spark):
    empty = build_model(corpus(spark, []), "article_id", "article_text")
    assert ranked(empty, "pawn") == []
    one = build_model(corpus(spark, ["pawn king"]), "article_id", "article_text")
    assert ranked(one, "pawn") == [(0, 0.0)]  # a term of every document weighs nothing
    odd = spark.createDataFrame([(5, "king rook"), (90, None), (7, ""), (40, "king rook"), (41, "of the")], "id bigint, t string")
    model = build_model(odd, "id", "t")
    assert model.meta.first()["n_docs"] == 5
    assert ranked(model, "rook") == [(5, pytest.approx(0.707107)), (40, pytest.approx(0.707107)), (7, 0.0), (41, 0.0), (90, 0.0)]
    with pytest.raises(ValueError):
        build_model(odd, "id", "t", entries=-1)
    with pytest.raises(ValueError):
        TextOptions(profile="other")
    clash = odd.select("id", "t", F.lit("x").alias("term"), F.lit("y").alias("text"), F.lit(1).alias("tf"), F.lit(2).alias("doc_id"))
    assert ranked(build_model(clash, "id", "t"), "rook")[0][0] == 5


def test_a_document_is_most_like_itself(spark):
    model = build_model(corpus(spark, CHESS), "article_id", "article_text")
    for k, text in enumerate(CHESS):
        assert ranked(model, text)[0] == (k, pytest.approx(1.0))


def test_partitions_do_not_matter(spark):
    df = corpus(spark, CHESS)
    a = build_model(df.repartition(3), "article_id", "article_text")
    b = build_model(df.orderBy(F.desc("article_id")).coalesce(1), "article_id", "article_text")
    assert ranked(a, "pawn king ox") == ranked(b, "pawn king ox")


def test_profiles_differ(spark):
    df = spark.createDataFrame([(0, "Alpha,b b"), (1, ""), (2, "alpha gamma")], "article_id bigint, article_text string")
    raw = {"stem": False, "clean": False}
    engine = build_model(df, "article_id", "article_text", TextOptions(**raw))
    oracle = build_model(df, "article_id", "article_text", TextOptions(profile="oracle", **raw))
    assert {r["term"] for r in engine.vocab.collect()} == {"Alpha,b", "alpha", "gamma"}
    assert {r["term"] for r in oracle.vocab.collect()} == {"alpha", "b", "gamma"}
    assert (engine.meta.first()["n_docs"], oracle.meta.first()["n_docs"]) == (3, 2)
    got = search.Session(oracle)
    assert [r["doc_id"] for r in got.search(1, "gamma").collect()] == [2, 0, 1]
    assert [r["doc_id"] for r in got.search(1).collect()] == [2, 0, 1]
    with pytest.raises(ValueError):
        got.search(2, "")
    assert with_stopwords(["alpha"], stem=False).stopwords == {"alpha"}


def test_lookup_and_reports(chess):
    assert chess.freq("knight", 0).first()["freq"] == 2 and chess.freq("knight", 3).first()["freq"] == 0
    assert chess.freq("unheard", 0).count() == 0
    assert chess.term_weight("knight", 0).first()["tf_weight"] == 2.0
    top = reports.top_words(chess, 2).where("doc_id = 0").orderBy("rank").collect()
    assert [r["term"] for r in top] == ["knight", "best"]
    assert [r["term"] for r in reports.top_idf(chess, 2).collect()] == ["best", "chess"]
    heads = reports.vector_heads(chess, 3)
    assert heads.columns == ["doc_id", "w1", "w2", "w3"] and heads.count() == 5
    assert set(reports.all_reports(chess)) == {"idf", "vectors", "norms", "top_words", "top_idf"}


def test_text_comes_late_and_null_text_is_left_out(spark):
    df = spark.createDataFrame([(0, "king " * 40), (1, None)], "article_id bigint, article_text string")
    model = build_model(df, "article_id", "article_text")
    rows = search.with_text(model, search.search_many(model, search.query_frame(model, {1: "king"}), 5)).collect()
    assert [(r["doc_id"], len(r["snippet"])) for r in rows] == [(0, 103)]


def test_store(spark, tmp_path):
    source = f"file://{tmp_path}/docs"
    corpus(spark, CHESS).write.parquet(source)
    store = ModelStore(f"file://{tmp_path}/models")
    first = store.get_or_build(spark.read.parquet(source), "article_id", "article_text")
    written = {p: p.stat().st_mtime_ns for p in (tmp_path / "models").rglob("*.parquet")}
    again = store.get_or_build(spark.read.parquet(source), "article_id", "article_text")
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "models").rglob("*.parquet")} == written
    assert ranked(first, "pawn king") == ranked(again, "pawn king")
    store.get_or_build(spark.read.parquet(source), "article_id", "article_text", TextOptions(stem=False))
    assert len(list((tmp_path / "models").iterdir())) == 2
    corpus(spark, CHESS[:2]).write.mode("overwrite").parquet(source)
    assert store.get_or_build(spark.read.parquet(source), "article_id", "article_text").meta.first()["n_docs"] == 2
    marks = [p for p in (tmp_path / "models").rglob("_SUCCESS") if p.parent.name == "vocab"]
    for m in marks:
        m.unlink()
    assert store.get_or_build(spark.read.parquet(source), "article_id", "article_text").meta.first()["n_docs"] == 2


@pytest.mark.parametrize("options", [{}, {"block_docs": 40, "chunk_terms": 30}, {"block_docs": 7}])
def test_batch_gives_what_single_searches_give(spark, options):
    rnd = random.Random(4)
    vocabulary = [f"w{int(rnd.paretovariate(0.6))}" for _ in range(4000)]
    texts = [" ".join(rnd.choices(vocabulary, k=rnd.randint(0, 30))) for _ in range(300)]
    model = build_model(corpus(spark, [*texts, None, texts[0], texts[1]]), "article_id", "article_text", TextOptions(stem=False), materialise="weights")
    asked = search.query_frame(model, {k: " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 9))) for k in range(60)} | {90: "w1", 91: "w1 w2 w3 w1", 92: "unheard", 93: "", 94: texts[0]})
    for k in (1, 10, 400):
        want = {tuple(r) for r in search.search_many(model, asked, k).collect()}
        got = [tuple(r) for r in search.search_batch(model, asked, k, **options).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert search.search_batch(model, asked, 0).count() == 0 == search.search_batch(model, asked.limit(0), 3).count()


def test_batch_over_nothing(spark):
    model = build_model(corpus(spark, []), "article_id", "article_text")
    assert search.search_batch(model, search.query_frame(model, {1: "pawn"})).count() == 0


def test_the_end_of_a_common_term_is_not_read():
    # 1000 documents hold term 1, three of them term 0 too, which alone makes the best two.
    at = np.r_[[5, 6, 7], np.arange(1000)]
    code = np.r_[[0, 0, 0], np.ones(1000, dtype=np.int64)]
    u = np.r_[[0.9, 0.8, 0.7], np.full(1000, 0.01)]
    ids = np.arange(1000) * 10
    for _ in range(2):
        (q, docs, scores), = search._best_of_block(np.array([1, 0]), np.array([0, 2]), np.array([0.5, 0.5]), (ids, at), code, u, 2)
        assert (q, docs.tolist()) == (0, [50, 60]) and scores.tolist() == pytest.approx([0.455, 0.405])


def test_a_block_gives_the_best_of_all_scores():
    rnd = np.random.default_rng(3)
    for n_docs, n_terms, n_post in ((3000, 12, 20_000), (3000, 400, 9_000), (40, 9, 200), (2000, 3, 5_000)):
        key = np.unique(rnd.integers(0, n_terms * n_docs, n_post))
        code, at = key // n_docs, key % n_docs
        u = rnd.choice([0.05, 0.1, 0.1000001, 0.25, 0.6], len(key))
        dense = np.zeros((n_terms + 2, n_docs))
        dense[code, at] = u
        mine = [rnd.choice(n_terms + 2, rnd.integers(1, 6), replace=False) for _ in range(60)]
        starts, terms = np.r_[0, np.cumsum([len(m) for m in mine])], np.concatenate(mine)
        weights = rnd.uniform(0.1, 0.6, len(terms))
        for k in (1, 10, 5000):
            got = {q: (d.tolist(), np.round(s, 6).tolist()) for q, d, s in search._best_of_block(terms, starts, weights, (np.arange(n_docs) * 3, at), code, u, k)}
            for q, m in enumerate(mine):
                score = np.round(weights[starts[q] : starts[q + 1]] @ dense[m], 6)
                best = np.lexsort((np.arange(n_docs), -score))[:k]
                best = best[score[best] > 0]
                assert got.get(q, ([], [])) == ((best * 3).tolist(), score[best].tolist())


def test_common_terms_cost_less_than_their_postings():
    # Three terms, each in half of the documents: adding up their postings is what a query must not cost.
    rnd = np.random.default_rng(5)
    n = 300_000
    lists = [np.flatnonzero(rnd.random(n) < 0.5) for _ in range(3)]
    at, code = np.concatenate(lists), np.repeat(np.arange(3), [len(x) for x in lists])
    u = 1 / rnd.uniform(8, 40, n)[at]
    terms, starts, weights = np.tile(np.arange(3), 100), np.arange(101) * 3, np.full(300, 3**-0.5)
    total, began = np.zeros(n), time.process_time()
    for _ in range(100):
        total[at] += weights[0] * u
    added, began = time.process_time() - began, time.process_time()
    assert len(list(search._best_of_block(terms, starts, weights, (np.arange(n), at), code, u, 10))) == 100
    assert time.process_time() - began < added / 2


def test_equal_queries_are_ranked_once(chess, monkeypatch):
    asked, ranked = [], search._score_blocks
    monkeypatch.setattr(search, "_score_blocks", lambda held, k: asked.append(held.value) or ranked(held, k))
    rows = search.search_batch(chess, search.query_frame(chess, {1: "pawn king", 2: "king, pawn!", 3: "unheard", 4: "", 5: "king", 6: "King pawn"}), 3).collect()
    assert [len(query) for query, *_ in asked] == [2]
    by = {q: sorted((r["rank"], r["doc_id"], r["similarity"]) for r in rows if r["query_id"] == q) for q in range(1, 7)}
    assert by[1] == by[2] == by[6] != by[5] and by[3] == by[4] == [(1, 0, 0.0), (2, 1, 0.0), (3, 2, 0.0)]


def test_texts_are_taken_apart_once_to_be_stemmed(spark):
    texts = spark.createDataFrame([(1, "Hoping, hopped hoping dying"), (2, None), (3, ""), (4, "the of"), (5, "skies 12,500 hopping hopes"), (1, "hopes")], "doc_id bigint, text string")
    counts = count_terms(texts, "doc_id", TextOptions())
    assert {tuple(r) for r in counts.collect()} == {(1, "hope", 3), (1, "hop", 1), (1, "die", 1), (5, "sky", 1), (5, "12,500", 1), (5, "hop", 1), (5, "hope", 1)}
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and "Join" not in plan
    assert count_terms(texts.limit(0), "doc_id", TextOptions()).count() == 0


def test_store_tells_selections_apart(spark, tmp_path):
    source = f"file://{tmp_path}/docs"
    corpus(spark, CHESS).write.parquet(source)
    store = ModelStore(f"file://{tmp_path}/models")
    df = spark.read.parquet(source)
    n = lambda x: store.get_or_build(x, "article_id", "article_text").meta.first()["n_docs"]
    assert [n(x) for x in (df, df.where("article_id < 3"), df.where("article_id < 2"), df, df.where("article_id < 3"), df.limit(1), df.where("article_text like '%rodeo%'"))] == [5, 3, 2, 5, 3, 1, 1]
    upper = F.udf(lambda t: t.upper(), "string")
    other = F.udf(lambda t: t[:4], "string")
    marks = {ModelStore.fingerprint(x, "article_id", "article_text", TextOptions(), 0) for x in (df, df.withColumn("article_text", upper("article_text")), df.withColumn("article_text", other("article_text")), df.withColumn("article_text", F.lit("a")), df.withColumn("article_text", F.lit("b")), df.union(df))}
    assert len(marks) == 6
    assert ModelStore.fingerprint(df.select("article_text", "article_id"), "article_id", "article_text", TextOptions(), 0) == ModelStore.fingerprint(spark.read.parquet(source).select("article_text", "article_id"), "article_id", "article_text", TextOptions(), 0)


def test_unknown_terms_tell_if_asked_to(chess):
    assert chess.freq("knight", 0, strict=True).first()["freq"] == 2
    with pytest.raises(KeyError):
        chess.freq("unheard", 0, strict=True)
    with pytest.raises(KeyError):
        chess.term_weight("unheard", 0, strict=True)
