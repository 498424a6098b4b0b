"""All queries of the core by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict = {}
_SQL: dict[str, str] = {}

#: What optional subpackages offer: ``residue`` gives the ids of records without genuine
#: text from a table of books, ``language`` the main language ``id, lang`` of ``(id, text)``.
hooks: dict = {}


def query(name: str, sql: str | None = None):
    """Register a query ``(spark, sf_dir) -> DataFrame`` under a name."""

    def register(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return register


def _load() -> None:
    from . import audit_queries, author_graph, book_pipelines, bounding_queries, corpus_queries, graph_queries, keyword_queries, model_queries, problems, text_queries, topic_checks, trend_queries, word_queries  # noqa: F401


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["text_stats_by_bucket"](spark, sf_dir)
