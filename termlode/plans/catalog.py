"""Every query of the engine by name, over whole tables, and the SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termlode.functions import text as T
from termlode.functions.stem import stem_column
from termlode.functions.stopwords import ENGLISH, SEPARATORS
from termlode.operators import reports, search
from termlode.operators.model import Model, TextOptions, build_model
from termlode.plans import sql
from termlode.plans.scratch import scratch_path
from termlode.plans.tables import spread, table
from termlode.sources import readers
from termlode.sources.store import ModelStore

PLAIN = TextOptions(stem=False)
ORACLE = TextOptions(stem=False, profile="oracle")
RAW = TextOptions(stem=False, clean=False)
QUESTION = "Northern treaty of the harbour harbour"
IDS = [7, 3, 999_999_999, 42, 0]

#: Texts with the quotes, escapes, runs of marks and digits around commas that the tables lack.
LITERALS = (
    r"the captain\'s \'last\' log", "D'Arcy sailed", "'tide came in", "went home'", "bread 'n' salt", "seven ''''''' marks here", "first line\n'second", "x'y'z", "x''y", "d'été d'Öland 'q", "salt,pepper",
    "12,500", "left,,right", "4,5,6", "4,,5", "many , , marks , in , one , line", "harbour\nand,quay,pier", "salt-and-pepper", "B-52", "--twice--over--", "quay\n-side-door", "m_-n", "ü-ñ -z", "N.A.T.O.", "release 2.7.1 final",
    "wait....then...", "mark . by . mark", 'deck"aft"', "mast~keel=rudder_", "all of these: k#l:m|n;o<p>q*r$s`t\\", "Über den Flüssen Öre", "tide 潮水", "thé → lemon", "Who? Never!", "bow/stern/keel",
    "the ship's wheel", "some 's and 's more", "that is anna's", "tab\there\x0bthere", "nbsp here　there", "", " ",
)
#: Published examples of the stemmer, and the terms of the worked ranking example.
STEMS = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consist": "consist", "consisted": "consist", "consistency": "consist", "consistent": "consist", "consistently": "consist",
    "consisting": "consist", "consists": "consist", "consolation": "consol", "consolations": "consol", "consolatory": "consolatori", "console": "consol", "consoled": "consol", "consoles": "consol", "consolidate": "consolid",
    "consolidated": "consolid", "consolidating": "consolid", "consoling": "consol", "consolingly": "consol", "consols": "consol", "consonant": "conson", "consort": "consort", "consorted": "consort", "consorting": "consort",
    "conspicuous": "conspicu", "conspicuously": "conspicu", "conspiracy": "conspiraci", "conspirator": "conspir", "conspirators": "conspir", "conspire": "conspir", "conspired": "conspir", "conspiring": "conspir",
    "constable": "constabl", "constables": "constabl", "constance": "constanc", "constancy": "constanc", "constant": "constant",
    "knack": "knack", "knackeries": "knackeri", "knacks": "knack", "knag": "knag", "knave": "knave", "knaves": "knave", "knavish": "knavish", "kneaded": "knead", "kneading": "knead", "knee": "knee", "kneel": "kneel",
    "kneeled": "kneel", "kneeling": "kneel", "kneels": "kneel", "knees": "knee", "knell": "knell", "knelt": "knelt", "knew": "knew", "knick": "knick", "knif": "knif", "knife": "knife", "knight": "knight", "knightly": "knight",
    "knights": "knight", "knit": "knit", "knits": "knit", "knitted": "knit", "knitting": "knit", "knives": "knive", "knob": "knob", "knobs": "knob", "knock": "knock", "knocked": "knock", "knocker": "knocker", "knockers": "knocker",
    "knocking": "knock", "knocks": "knock", "knopp": "knopp", "knot": "knot", "knots": "knot",
    "pieces": "piec", "involves": "involv", "lassoed": "lasso", "horse": "hors", "police": "polic", "officers": "offic", "literature": "literatur", "shakespeare": "shakespear", "english": "english", "pawn": "pawn", "game": "game",
    "move": "move", "rodeo": "rodeo", "threw": "threw", "jail": "jail", "skies": "sky", "dying": "die", "news": "news", "generate": "generat", "generously": "generous", "hoping": "hope", "hopping": "hop",
}


#: Published examples of the Portuguese stemmer.
STEMS_PORTUGUESE = dict(
    pair.split()
    for pair in (
        "boa boa,boainain boainain,boas boas,bôas bôas,boassu boassu,boataria boat,boate boat,boates boat,boatos boat,bob bob,boba bob,bobagem bobag,bobagens bobagens,bobalhões bobalhõ,bobear bob,bobeira bobeir,"
        "bobinho bobinh,bobinhos bobinh,bobo bob,bobs bobs,boca boc,bocadas boc,bocadinho bocadinh,bocado boc,bocaiúva bocaiúv,boçal boçal,bocarra bocarr,bocas boc,bode bod,bodoque bodoqu,body body,boeing boeing,"
        "boem boem,boemia boem,boêmio boêmi,boêmios boêmi,quilométricas quilométr,quilométricos quilométr,quilômetro quilômetr,quilômetros quilômetr,quilos quil,química químic,químicas químic,químico químic,"
        "químicos químic,quimioterapia quimioterap,quimioterápicos quimioteráp,quinhão quinhã,quinta quint,quintal quintal,quinto quint,quinze quinz,quinzena quinzen,quiosque quiosqu"
    ).split(",")
)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _texts_of(spark: SparkSession, d: str) -> DataFrame:
    return spread(_docs(spark, d).select("doc_id", "text"))


def _model(spark: SparkSession, d: str, options: TextOptions = PLAIN) -> Model:
    return build_model(_texts_of(spark, d), "doc_id", "text", options, materialise="counts")


def _r(name: str, digits: int = 6) -> Column:
    return F.round(name, digits).alias(name)


def _literal_texts(spark: SparkSession, d: str) -> DataFrame:
    own = spark.createDataFrame([(-1 - k, t) for k, t in enumerate(LITERALS)], "doc_id bigint, text string")
    return _texts_of(spark, d).unionByName(own)


def _cleaning(function) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _literal_texts(spark, d).select("doc_id", function(F.col("text")).alias("cleaned"))


def _token_counts(tokens) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _literal_texts(spark, d).select("doc_id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


def _question(model: Model) -> DataFrame:
    return search.query_frame(model, {1: QUESTION})


def _asked(spark: SparkSession, d: str, tbl: int) -> DataFrame:
    return table(spark, d, "queries").where(F.col("tbl") == tbl).select(F.col("query_id").cast("bigint").alias("query_id"), F.col("query").alias("text")).distinct()


def _articles(spark: SparkSession, d: str, tbl: int) -> DataFrame:
    return spread(table(spark, d, f"test_tbl_{tbl}").select("article_id", "article_text")).distinct()


def _with_question(make, options: TextOptions = PLAIN) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        model = build_model(_texts_of(spark, d), "doc_id", "text", options, materialise="weights")
        return make(model, _question(model))

    return run


def _search_tables(options: TextOptions):
    """Every table's own queries over that table, for all tables that queries name; those that don't exist are skipped."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        out = spark.createDataFrame([], "tbl int, query_id bigint, rank int, doc_id bigint, similarity double")
        for tbl in _named_tables(spark, d):
            model = build_model(_articles(spark, d, tbl), "article_id", "article_text", options, materialise="weights")
            out = out.unionByName(search.search_batch(model, _asked(spark, d, tbl), 10).select(F.lit(tbl).alias("tbl"), "query_id", "rank", "doc_id", "similarity"))
        return out

    return run


def _named_tables(spark: SparkSession, d: str) -> list[int]:
    """The tables that queries name and that exist; as many names as there are tables come to the driver."""
    named = sorted(r["tbl"] for r in table(spark, d, "queries").select("tbl").where("tbl IS NOT NULL").distinct().collect())
    return [tbl for tbl in named if readers.path_exists(spark, f"{d}/test_tbl_{tbl}.parquet")]


def _search_batch(options: TextOptions):
    def run(spark: SparkSession, d: str) -> DataFrame:
        model = build_model(_articles(spark, d, 3), "article_id", "article_text", options, materialise="weights")
        return search.search_batch(model, _asked(spark, d, 3), 10)

    return run


def _query_list(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "queries").where(F.col("tbl").isin(_named_tables(spark, d))).select("tbl", "query_id", F.trim("query").alias("query")).distinct()


def _query_tsv(spark: SparkSession, d: str) -> DataFrame:
    """The query table written as TSV and read again; texts that hold a tab or a line end can't stand in a TSV."""
    path = scratch_path(spark, "queries_tsv")
    rows = table(spark, d, "queries").where(~F.col("query").rlike(r"[\t\r\n]")).select("tbl", "query_id", "query")
    rows.write.csv(path, sep="\t", header=True, quote="", escape="")
    return readers.read_queries_tsv(spark, path)


def _roundtrip(spark: SparkSession, d: str) -> DataFrame:
    store = ModelStore(scratch_path(spark, "models"))
    store.get_or_build(_texts_of(spark, d), "doc_id", "text", PLAIN)
    return store.get_or_build(_texts_of(spark, d), "doc_id", "text", PLAIN).postings.select("doc_id", "term", "tf", _r("w"))


def _by_ids(spark: SparkSession, d: str) -> DataFrame:
    return readers.by_ids(_docs(spark, d), "doc_id", "text", IDS)


def _stem_golden(words: dict[str, str], language: str):
    return lambda spark, d: spark.createDataFrame([(w,) for w in words], "word string").select("word", stem_column(F.col("word"), language).alias("stem"))


def _vocabulary_stems(spark: SparkSession, d: str) -> DataFrame:
    """Stems of all terms of the documents."""
    return build_model(_texts_of(spark, d), "doc_id", "text", PLAIN).tf.select("term").distinct().select("term", stem_column(F.col("term")).alias("stem"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "corpus_count": lambda s, d: readers.row_count(_docs(s, d)),
        "doc_prefix": lambda s, d: readers.id_prefix(_docs(s, d), "doc_id", 50).select("doc_id", "text"),
        "doc_range_scan": lambda s, d: readers.id_range(_docs(s, d), "doc_id", 10, 60).select("doc_id", "text"),
        "doc_point_lookup": _by_ids,
        "doc_ordered_scan": lambda s, d: readers.ordered_scan(_docs(s, d), "doc_id", "text", 10, 60),
        "query_list": _query_list,
        "query_tsv": _query_tsv,
        "clean_lower": _cleaning(T.lower),
        "remove_accents": _cleaning(lambda c: T.remove_accents(c)),
        "strip_accents_ascii": _cleaning(lambda c: T.accents_to_ascii(T.lower(c))),
        "remove_non_ascii": _cleaning(T.remove_non_ascii),
        "printable_ascii": _cleaning(T.printable_ascii),
        "printable_lower_quotes": _cleaning(T.printable_lower_quotes),
        "unescape_quotes": _cleaning(T.unescape_quotes),
        "clean_quotes": _cleaning(T.clean_quotes),
        "clean_commas": _cleaning(T.clean_commas),
        "clean_dashes": _cleaning(T.clean_dashes),
        "clean_dots": _cleaning(T.clean_dots),
        "clean_symbols": _cleaning(T.clean_symbols),
        "clean_qmark": _cleaning(T.remove_question_exclamation),
        "clean_apostrophe_s": _cleaning(T.remove_apostrophe_s),
        "clean_text": _cleaning(T.clean_text),
        "tokenize_ws": _token_counts(T.tokenize_blanks),
        "tokenize_sep": _token_counts(lambda c: T.tokenize_separators(c, SEPARATORS)),
        "filter_stopwords": _token_counts(lambda c: T.filter_tokens(T.tokenize_blanks(T.lower(c)), ENGLISH, least_bytes=2)),
        "snippet": lambda s, d: _literal_texts(s, d).select("doc_id", T.snippet(F.col("text")).alias("snippet")),
        "term_freq": lambda s, d: _model(s, d).tf,
        "doc_freq": lambda s, d: _model(s, d).vocab.select("term", "df"),
        "idf": lambda s, d: _model(s, d).vocab.select("term", _r("idf")),
        "vocab_size": lambda s, d: _model(s, d).meta.select("n_docs", "vocab_size"),
        "vocab_size_oracle": lambda s, d: _model(s, d, ORACLE).meta.select("n_docs", "vocab_size"),
        "term_lookup": lambda s, d: _model(s, d).freq("treaty", 5),
        "term_weight": lambda s, d: _model(s, d).term_weight("treaty", 5).select(_r("tf_weight")),
        "tfidf_weights": lambda s, d: _model(s, d).postings.select("doc_id", "term", "tf", _r("w")),
        "tfidf_weights_oracle": lambda s, d: _model(s, d, ORACLE).postings.select("doc_id", "term", "tf", _r("w")),
        "doc_norms": lambda s, d: reports.norm_list(_model(s, d)).select("doc_id", _r("norm")),
        "query_vector": _with_question(lambda m, q: search.query_vectors(m, q).select("query_id", "term", "tf", _r("w"))),
        "query_vector_uncleaned": _with_question(lambda m, q: search.query_vectors(m, q).select("query_id", "term", "tf", _r("w")), RAW),
        "query_norm": _with_question(lambda m, q: search.query_norms(q, search.query_vectors(m, q)).select("query_id", _r("norm"))),
        "dot_product": _with_question(lambda m, q: search.dot_products(m, search.query_vectors(m, q)).select("query_id", "doc_id", _r("dot"))),
        "similarity_all": _with_question(search.similarity_all),
        "rank_all_oracle": _with_question(search.rank_all, ORACLE),
        "search_topk": _with_question(lambda m, q: search.search_many(m, q, 10)),
        "search_topk_text": _with_question(lambda m, q: search.with_text(m, search.search_many(m, q, 10))),
        "search_topk_stemmed": _with_question(lambda m, q: search.search_many(m, q, 10), TextOptions()),
        "search_tables": _search_tables(PLAIN),
        "search_tables_stemmed": _search_tables(TextOptions()),
        "search_batch": _search_batch(PLAIN),
        "search_batch_stemmed": _search_batch(TextOptions()),
        "top_words_per_doc": lambda s, d: reports.top_words(_model(s, d)).select("doc_id", "rank", "term", _r("w")),
        "idf_report": lambda s, d: reports.idf_list(_model(s, d)).select("term", "df", _r("idf")),
        "top_idf": lambda s, d: reports.top_idf(_model(s, d)).select("term", _r("idf")),
        "vector_report": lambda s, d: (lambda v: v.select("doc_id", *[_r(c) for c in v.columns[1:]]))(reports.vector_heads(_model(s, d))),
        "stem_golden": _stem_golden(STEMS, "english"),
        "stem_golden_portuguese": _stem_golden(STEMS_PORTUGUESE, "portuguese"),
        "stem_vocabulary": _vocabulary_stems,
        "model_roundtrip": _roundtrip,
    }


_DOCS = "SELECT doc_id, text FROM documents"
_ASK = f"SELECT 1 AS query_id, {sql.quoted(QUESTION)} AS text"


def _texts() -> str:
    rows = ", ".join(f"({-1 - k}, {_literal(t)})" for k, t in enumerate(LITERALS))
    return f"({_DOCS} UNION ALL SELECT * FROM (VALUES {rows}) v(doc_id, text))"


def _literal(t: str) -> str:
    for ch in "\n\t\x0b":
        if ch in t:
            return " || ".join(f"chr({ord(p)})" if p == ch else sql.quoted(p) for p in _parts(t))
    return sql.quoted(t)


def _parts(t: str) -> list[str]:
    out, held = [], ""
    for c in t:
        if c in "\n\t\x0b":
            out += [held, c]
            held = ""
        else:
            held += c
    return [*out, held]


def _counted(split: str, term: str, keep: str, source: str = "text") -> str:
    return f"SELECT doc_id, {term} AS token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array({source}, '{split}')) AS t FROM {_texts()}) WHERE {keep} GROUP BY ALL"


def _pairs(words: dict[str, str]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({sql.quoted(w)}, {sql.quoted(x)})" for w, x in words.items()) + ") v(word, stem)"


def _table_sql(tbl: int, stem: bool) -> str:
    docs = f"SELECT DISTINCT article_id AS doc_id, article_text AS text FROM test_tbl_{tbl}"
    asked = f"SELECT DISTINCT CAST(query_id AS BIGINT) AS query_id, query AS text FROM queries WHERE tbl = {tbl}"
    return sql.model(docs, stem=stem) + sql.scores(asked, stem=stem)


def _tables_sql(stem: bool) -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({_table_sql(tbl, stem)} SELECT {tbl} AS tbl, query_id, CAST(rank AS INTEGER) AS rank, doc_id, similarity FROM ranked WHERE rank <= 10)" for tbl in (0, 1, 2, 3))


def oracle_sql() -> dict[str, str]:
    model, oracle, ask = sql.model(_DOCS), sql.model(_DOCS, "oracle"), sql.scores(_ASK)
    top = "SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, similarity FROM ranked WHERE rank <= 10"
    stemmed = sql.model(_DOCS, stem=True) + sql.scores(_ASK, stem=True)
    raw = sql.model(_DOCS, cleaned=False) + sql.scores(_ASK, cleaned=False)
    heads = "first10 AS (SELECT term, row_number() OVER (ORDER BY term) AS k FROM vocab ORDER BY term LIMIT 10)"
    columns = ", ".join(f"round(coalesce(sum(w) FILTER (WHERE k = {k}), 0), 6) AS w{k}" for k in range(1, 11))
    out = {
        "corpus_count": "SELECT count(*) AS n_rows FROM documents",
        "doc_prefix": f"{_DOCS} WHERE doc_id < 50",
        "doc_range_scan": f"{_DOCS} WHERE doc_id BETWEEN 10 AND 60",
        "doc_point_lookup": "SELECT rank, id, text FROM (VALUES " + ", ".join(f"({k}, {i})" for k, i in enumerate(IDS, 1)) + ") v(rank, id) LEFT JOIN documents ON id = doc_id",
        "doc_ordered_scan": "SELECT doc_id AS id, text FROM documents WHERE doc_id BETWEEN 10 AND 60 ORDER BY doc_id",
        "query_list": "SELECT DISTINCT tbl, query_id, trim(query) AS query FROM queries WHERE tbl IN (0, 1, 2, 3)",
        "query_tsv": r"SELECT tbl, query_id, trim(query) AS query FROM queries WHERE query IS NOT NULL AND NOT regexp_matches(query, '[\t\r\n]')",
        "strip_accents_ascii": f"SELECT doc_id, {sql.STEPS['accents_to_ascii']('lower(text)')} AS cleaned FROM {_texts()}",
        "printable_lower_quotes": f"SELECT doc_id, {sql.STEPS['clean_quotes'](sql.STEPS['printable_ascii']('lower(text)'))} AS cleaned FROM {_texts()}",
        "clean_text": f"SELECT doc_id, {sql.clean('text')} AS cleaned FROM {_texts()}",
        "tokenize_ws": _counted(r"[ \t\n\r]+", "t", "t <> ''"),
        "tokenize_sep": _counted("[ ,.!?:;/]", "lower(t)", "t <> ''"),
        "filter_stopwords": _counted(r"[ \t\n\r]+", "t", f"t <> '' AND strlen(t) > 1 AND t NOT IN ({sql.STOP})", "lower(text)"),
        "snippet": f"SELECT doc_id, CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS snippet FROM {_texts()}",
        "term_freq": f"{model} SELECT doc_id, term, tf FROM tf",
        "doc_freq": f"{model} SELECT term, df FROM vocab",
        "idf": f"{model} SELECT term, round(idf, 6) AS idf FROM vocab",
        "vocab_size": f"{model} SELECT n_docs, (SELECT count(*) FROM vocab) AS vocab_size FROM meta",
        "vocab_size_oracle": f"{oracle} SELECT n_docs, (SELECT count(*) FROM vocab) AS vocab_size FROM meta",
        "term_lookup": f"{model} SELECT CAST(coalesce((SELECT sum(tf) FROM tf WHERE term = 'treaty' AND doc_id = 5), 0) AS BIGINT) AS freq FROM vocab WHERE term = 'treaty'",
        "term_weight": f"{model} SELECT CASE WHEN f > 0 THEN round(1 + log2(f), 6) ELSE 0.0 END AS tf_weight FROM (SELECT coalesce((SELECT sum(tf) FROM tf WHERE term = 'treaty' AND doc_id = 5), 0) AS f FROM vocab WHERE term = 'treaty')",
        "tfidf_weights": f"{model} SELECT doc_id, term, tf, round(w, 6) AS w FROM postings",
        "tfidf_weights_oracle": f"{oracle} SELECT doc_id, term, tf, round(w, 6) AS w FROM postings",
        "doc_norms": f"{model} SELECT doc_id, round(norm, 6) AS norm FROM norms",
        "query_vector": f"{model}{ask} SELECT CAST(query_id AS BIGINT) AS query_id, term, tf, round(w, 6) AS w FROM qvec",
        "query_vector_uncleaned": f"{raw} SELECT CAST(query_id AS BIGINT) AS query_id, term, tf, round(w, 6) AS w FROM qvec",
        "query_norm": f"{model}{ask} SELECT CAST(query_id AS BIGINT) AS query_id, round(norm, 6) AS norm FROM qnorm",
        "dot_product": f"{model}{ask} SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, round(dot, 6) AS dot FROM dots",
        "similarity_all": f"{model}{ask} SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, similarity FROM sims",
        "rank_all_oracle": f"{oracle}{sql.scores(_ASK, 'oracle')} SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, similarity, CAST(rank AS INTEGER) AS rank FROM ranked",
        "search_topk": f"{model}{ask} {top.replace('query_id', 'CAST(query_id AS BIGINT) AS query_id')}",
        "search_topk_text": f"{model}{ask} SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS INTEGER) AS rank, doc_id, similarity, CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS snippet FROM ranked JOIN docs USING (doc_id) WHERE rank <= 10 AND text IS NOT NULL",
        "search_topk_stemmed": f"{stemmed} {top.replace('query_id', 'CAST(query_id AS BIGINT) AS query_id')}",
        "search_tables": _tables_sql(False),
        "search_tables_stemmed": _tables_sql(True),
        "search_batch": f"{_table_sql(3, False)} {top}",
        "search_batch_stemmed": f"{_table_sql(3, True)} {top}",
        "top_words_per_doc": f"{model} SELECT doc_id, CAST(rank AS INTEGER) AS rank, term, round(w, 6) AS w FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 9) DESC, term) AS rank FROM postings WHERE w > 0) WHERE rank <= 10",
        "idf_report": f"{model} SELECT term, df, round(idf, 6) AS idf FROM vocab ORDER BY term LIMIT 20",
        "top_idf": f"{model} SELECT term, round(idf, 6) AS idf FROM vocab ORDER BY round(idf, 9) DESC, term LIMIT 5",
        "vector_report": f"{model}, {heads} SELECT doc_id, {columns} FROM docs LEFT JOIN (SELECT * FROM postings JOIN first10 USING (term)) USING (doc_id) GROUP BY doc_id",
        "stem_golden": _pairs(STEMS),
        "stem_golden_portuguese": _pairs(STEMS_PORTUGUESE),
        "stem_vocabulary": f"{sql.model(_DOCS, stem=True)} SELECT term, stem FROM tf_stems",
        "model_roundtrip": f"{model} SELECT doc_id, term, tf, round(w, 6) AS w FROM postings",
    }
    for step, make in sql.STEPS.items():
        if step != "accents_to_ascii":
            out.setdefault(step, f"SELECT doc_id, {make('text')} AS cleaned FROM {_texts()}")
    return out
