import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termlode.functions import text as T
from termlode.functions.stem import stem_english
from termlode.functions.stem_portuguese import stem_portuguese
from termlode.functions.stopwords import ENGLISH, SEPARATORS, read_words
from termlode.plans.catalog import STEMS, STEMS_PORTUGUESE

CASES = {
    T.unescape_quotes: [(r"the \'last\' log", "the 'last' log")],
    T.clean_quotes: [("D'Arcy sailed", "D'Arcy sailed"), ("'tide came in", "tide came in"), ("bread 'n' salt", "bread n salt"), ("seven ''''''' marks here", "seven marks here"), ("first line\n'second", "first line second"), ("x'y'z", "x'y'z"), ("x''y", "x y"), ("d'été", "d'été"), ("1'2", "1 2")],
    T.clean_commas: [("salt,pepper", "salt pepper"), ("12,500", "12,500"), ("left,,right", "left right"), ("many , , marks , in , one , line", "many marks in one line"), ("4,5,6", "4,5,6"), ("4,,5", "4 5")],
    T.clean_dashes: [("salt-and-pepper", "salt-and-pepper"), ("--twice--over--", "twice over"), ("quay\n-side-door", "quay side-door"), ("ü-ñ", "ü-ñ")],
    T.clean_dots: [("N.A.T.O.", "N.A.T.O"), ("wait....then...", "wait then"), ("2.71 ist e", "2.71 ist e")],
    T.clean_symbols: [("all of these: k#l:m|n;o<p>q*r$s`t\\", "all of these k l m n o p q r s t"), ('deck"aft"', "deck aft"), ("mast~keel=rudder_", "mast keel rudder")],
    T.remove_accents: [("Über den Flüssen Öre", "Uber den Flussen Ore"), ("naïf 潮水", "naif 潮水")],
    T.remove_non_ascii: [("thé → lemon", "th  lemon"), ("tide 潮水", "tide ")],
    T.remove_question_exclamation: [("bow/stern/keel", "bow stern keel"), ("Who? Never!", "Who Never")],
    T.remove_apostrophe_s: [("the ship's wheel", "the ship wheel"), ("some 's and 's more", "some and more"), ("that is anna's", "that is anna's")],
    T.printable_ascii: [("a\nb\tc é", "abc e")],
    T.clean_text: [("É", "e"), ("The SHIP's 1,000 — a_-b, N.A.T.O.!", "the ship 1,000 a -b n.a.t.o")],
}


@pytest.mark.parametrize("function", CASES, ids=lambda f: f.__name__)
def test_cleaning(spark, function):
    pairs = [*CASES[function], (None, None), ("", "")]
    rows = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(pairs)], "k int, t string").select("k", function(F.col("t")).alias("x")).orderBy("k").collect()
    assert [r["x"] for r in rows] == [b for _, b in pairs]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab1,.-'_\\?/!: é\n", max_size=25), min_size=1, max_size=20))
def test_fused_cleaning_is_the_steps_in_order(spark, texts):
    def steps(c):
        c = T.remove_non_ascii(T.remove_accents(T.lower(c)))
        for f in (T.unescape_quotes, T.clean_quotes, T.clean_commas, T.clean_dashes, T.clean_dots, T.clean_symbols, T.remove_question_exclamation, T.remove_apostrophe_s):
            c = f(c)
        return c

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", T.clean_text(F.col("t")).alias("a"), steps(F.col("t")).alias("b")).collect():
        assert r["a"] == r["b"], r["t"]


def test_accent_table_is_what_decomposition_says():
    source, target = T._ascii_bases()
    assert len(source) == len(target) == 495
    assert all(unicodedata.normalize("NFD", s)[0] == t for s, t in zip(source, target, strict=True))


def test_tokens(spark):
    df = spark.createDataFrame([(" a  bb\tthe\nccc\x0bd ",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(T.tokenize_blanks(F.col("t"))).collect()] == [["a", "bb", "the", "ccc\x0bd"], None, []]
    df = spark.createDataFrame([("One,two;THREE four\tfive",)], "t string")
    assert df.select(T.tokenize_separators(F.col("t"), SEPARATORS)).first()[0] == ["one", "two", "three", "four\tfive"]
    df = spark.createDataFrame([(["a", "The", "the", "é", "xx"],)], "t array<string>")
    assert df.select(T.filter_tokens(F.col("t"), ENGLISH, 2)).first()[0] == ["The", "é", "xx"]
    assert df.select(T.filter_tokens(F.col("t"), [], 0)).first()[0] == ["a", "The", "the", "é", "xx"]


def test_snippet(spark):
    df = spark.createDataFrame([("é" * 100,), ("é" * 101,), (None,)], "t string")
    assert [r[0] for r in df.select(T.snippet(F.col("t"))).collect()] == ["é" * 100, "é" * 100 + "...", None]


def test_stopword_file(tmp_path):
    (tmp_path / "stop").write_bytes(b"the\r\n\nof\n")
    assert read_words(tmp_path / "stop") == ["the", "of"]
    assert len(ENGLISH) == len(set(ENGLISH)) == 198


@pytest.mark.parametrize(("word", "stem"), STEMS.items())
def test_stemmer(word, stem):
    assert stem_english(word) == stem


@pytest.mark.parametrize(("word", "stem"), STEMS_PORTUGUESE.items())
def test_portuguese_stemmer(word, stem):
    assert stem_portuguese(word) == stem


@given(st.text(alphabet="abcdeilnorstuy'-", max_size=12))
def test_stemmer_takes_anything(word):
    assert len(stem_english(word)) <= len(word) + 1
