"""Models straight from a source, in the oracle profile."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import SparkSession

from termlode.functions.stopwords import SEPARATORS, as_set
from termlode.operators.model import Model, TextOptions, build_model
from termlode.sources.readers import read_directory, read_sqlite


def read_separators(path: str | Path) -> tuple[str, ...]:
    """One separator per line; a line that is a space counts."""
    return tuple(s for s in Path(path).read_text(encoding="utf-8").splitlines() if s)


def _options(stopwords: Iterable[str] | None, language: str, stem: bool, separators: str | Path | None) -> TextOptions:
    chosen = read_separators(separators) if separators else SEPARATORS
    return TextOptions(profile="oracle", clean=False, stem=stem, language=language, stopwords=as_set(stopwords), separators=chosen)


def model_from_table(spark: SparkSession, database: str, table: str, stopwords: Iterable[str] | None = None, *, stem: bool = True, separators: str | Path | None = None) -> Model:
    """Model of a SQLite table, English by default."""
    return build_model(read_sqlite(spark, database, table), "article_id", "article_text", _options(stopwords, "english", stem, separators))


def model_from_directory(spark: SparkSession, base: str, stopwords: Iterable[str] = (), *, docs: str = "documentos", stem: bool = True, separators: str | Path | None = None) -> Model:
    """Model of a directory of ``doc<N>.txt``, with the Portuguese stemmer; the stop words are the caller's."""
    return build_model(read_directory(spark, base, docs), "doc_id", "text", _options(stopwords, "portuguese", stem, separators))
