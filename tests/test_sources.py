import re
import sqlite3

import pytest

from termlode import cli
from termlode.sources import models, readers


def test_tsv(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('article_id\tarticle_text\n0  \tone "quoted\n1\ttwo\n', encoding="utf-8")
    assert [tuple(r) for r in readers.read_articles_tsv(spark, str(tmp_path / "a.tsv")).orderBy("article_id").collect()] == [(0, 'one "quoted'), (1, "two")]
    (tmp_path / "q.tsv").write_text("table\tquery_id\tquery\n3 \t2 \tb \n1\t1\ta\n\n", encoding="utf-8")
    assert [tuple(r) for r in readers.read_queries_tsv(spark, str(tmp_path / "q.tsv")).collect()] == [(1, 1, "a"), (3, 2, "b")]


def test_directory(spark, tmp_path):
    (tmp_path / "documentos").mkdir()
    for n in (2, 10, 1):
        (tmp_path / "documentos" / f"doc{n}.txt").write_text(f"text {n}\nline", encoding="utf-8")
    (tmp_path / "documentos" / "other.txt").write_text("x", encoding="utf-8")
    assert [tuple(r) for r in readers.read_directory(spark, str(tmp_path)).orderBy("doc_id").collect()] == [(0, "text 1\nline"), (1, "text 2\nline"), (2, "text 10\nline")]


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "a.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE sample_articles (article_id INTEGER PRIMARY KEY, article_text TEXT)")
        db.executemany("INSERT INTO sample_articles VALUES (?, ?)", [(k, None if k == 3 else f"Rook number n{k}, king's") for k in range(0, 40, 3)])
    return path


def test_sqlite(spark, database):
    got = readers.read_sqlite(spark, database, partitions=4)
    assert [r["article_id"] for r in got.orderBy("article_id").collect()] == list(range(0, 40, 3))
    assert got.where("article_text IS NULL").count() == 1
    with pytest.raises(FileNotFoundError):
        readers.read_sqlite(spark, database + "x")
    with pytest.raises(ValueError):
        readers.read_sqlite(spark, database, "other")


def test_scans(spark):
    df = spark.createDataFrame([(k, f"t{k}", "x") for k in range(5)], "id bigint, t string, text string")
    assert readers.id_range(df, "id", 1, 3).count() == 3
    assert readers.id_prefix(df, "id", 2).count() == 2 and readers.id_prefix(df, "id", 0).count() == 5 == readers.id_prefix(df, "id", 99).count()
    assert [tuple(r) for r in readers.by_ids(df, "id", "t", [4, 9, 0]).orderBy("rank").collect()] == [(1, 4, "t4"), (2, 9, None), (3, 0, "t0")]
    with pytest.raises(ValueError):
        readers.id_prefix(df, "id", -1)


def test_query_file(tmp_path):
    (tmp_path / "q").write_text("a query\n", encoding="utf-8")
    assert readers.read_query_file(tmp_path / "q") == "a query\n"
    (tmp_path / "e").write_text(" \n", encoding="utf-8")
    with pytest.raises(ValueError):
        readers.read_query_file(tmp_path / "e")


def test_cli(spark, database, tmp_path, capsys):
    assert cli.main(["search", "--db", database, "--query_user", "rook number n9", "--k", "3", "--models", f"file://{tmp_path}/m"], spark) == 0
    assert re.match(r"\[9\] [01]\.\d{6}  ", capsys.readouterr().out)
    (tmp_path / "q.tsv").write_text("table\tquery_id\tquery\n7\t1\trook number n9\n9\t1\trook\n7\t2\t\n", encoding="utf-8")
    spark.createDataFrame([(3, "rook number n9"), (4, "king")], "article_id bigint, article_text string").write.parquet(f"file://{tmp_path}/tables/test_tbl_7.parquet")
    assert cli.main(["batch", "--db", f"file://{tmp_path}/tables", "--queries", str(tmp_path / "q.tsv"), "--k", "1", "--models", f"file://{tmp_path}/m"], spark) == 0
    assert capsys.readouterr().out.split("\n")[:2] == ["test_tbl_7 1 [3] 1.000000  rook number n9", "test_tbl_9: no such table, skipped"]
    assert cli.main(["clean", "The CAT's tail!"], spark) == 0
    assert capsys.readouterr().out.strip() == "the cat tail"
    assert cli.main(["clean", "-d", database, "-t", "sample_articles", "-o", f"file://{tmp_path}/clean"], spark) == 0
    assert spark.read.parquet(f"file://{tmp_path}/clean").where("article_text = 'rook number n0 king''s'").count() == 1
    assert cli.main(["model", "-d", database, "-t", "sample_articles", "-q", "rook number n9"], spark) == 0
    assert "rank" in capsys.readouterr().out
    (tmp_path / "query").write_text("rook number n9\n", encoding="utf-8")
    assert cli.main(["model", "-d", database, "-t", "sample_articles", "-f", str(tmp_path / "query")], spark) == 0
    with pytest.raises(ValueError):
        cli.main(["model", "-d", database, "-t", "sample_articles"], spark)
    with pytest.raises(SystemExit) as end:
        cli.main(["search", "--unknown"], spark)
    assert end.value.code == 1
    assert cli.main(["search", "--db", database, "--query_user", "rook", "--k", "1", "--test", "1", "--models", f"file://{tmp_path}/m"], spark) == 0


def test_models_from_sources(spark, database, tmp_path):
    (tmp_path / "documentos").mkdir()
    (tmp_path / "documentos" / "doc1.txt").write_text("Os bobinhos químicos", encoding="utf-8")
    (tmp_path / "documentos" / "doc2.txt").write_text("os quiosque", encoding="utf-8")
    (tmp_path / "separators").write_text(" \n,\n", encoding="utf-8")
    model = models.model_from_directory(spark, str(tmp_path), ["os"], separators=tmp_path / "separators")
    assert {r["term"] for r in model.vocab.collect()} == {"bobinh", "químic", "quiosqu"}
    assert models.model_from_table(spark, database, "sample_articles").meta.first()["n_docs"] == 13
