"""The staged pipelines over the book tables, end to end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cleaning, graph, mentions
from ..runtime import shared_dir
from .pipelines import Stage, run
from .registry import query


def _one_record(books):
    return books.where("book_id is not null").groupBy("book_id").agg(F.max("work_id").alias("work_id"), F.max("description").alias("description"), F.max("authors").alias("authors"))


def _dated(books, works):
    years = works.select("work_id", T.year_in(F.col("original_publication_year"), 2017).alias("year")).where("year >= 1900")
    return _one_record(books).where("length(description) >= 80").join(years, "work_id").select("book_id", "work_id", "description", T.decade("year").alias("decade"))


def _cleaned(dated):
    return cleaning.clean_corpus(dated, "book_id", "description").join(dated.select("book_id", "decade"), "book_id")


def _decade_words(cleaned):
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return cleaned.groupBy("decade").agg(F.count(F.lit(1)).alias("n"), F.avg(words).alias("words"))


def _author_docs(books):
    return _one_record(books).select(F.coalesce("work_id", -F.col("book_id")).alias("doc"), F.explode("authors.author_id").alias("key")).distinct()


def _author_edges(books):
    return mentions.comention_edges(_author_docs(books), "doc")


def _ranked(edges, communities):
    return graph.rank_in_group(communities.join(graph.weighted_degree(edges), "node"), [F.desc("degree"), F.col("node")])


def corpus_stages(sf_dir: str, out: str) -> list[Stage]:
    """Records with years, their texts without repeated sentences, and what is left in each decade."""
    books, works = f"{sf_dir}/goodreads_books.parquet", f"{sf_dir}/goodreads_book_works.parquet"
    return [
        Stage("dated", _dated, (books, works), f"{out}/dated"),
        Stage("cleaned", _cleaned, (f"{out}/dated",), f"{out}/cleaned"),
        Stage("decades", _decade_words, (f"{out}/cleaned",), f"{out}/decades"),
    ]


def circle_stages(sf_dir: str, out: str) -> list[Stage]:
    """Edges between authors, communities of them, and the rank of each member."""
    books = f"{sf_dir}/goodreads_books.parquet"
    return [
        Stage("edges", _author_edges, (books,), f"{out}/edges"),
        Stage("communities", lambda b: graph.leiden_of_texts(_author_docs(b), gamma=1.0), (books,), f"{out}/communities"),
        Stage("ranks", _ranked, (f"{out}/edges", f"{out}/communities"), f"{out}/ranks"),
    ]


@query("pipeline_runs")
def pipeline_runs(spark, sf_dir):
    """Both pipelines run from their start: ``pipeline, stage, ran, reason, n_rows``."""
    out, rows = f"{shared_dir(spark).rstrip('/')}/pipelines-{uuid.uuid4().hex}", []
    for name, stages in (("corpus", corpus_stages(sf_dir, out)), ("circles", circle_stages(sf_dir, out))):
        for (stage, ran, reason), s in zip(run(spark, stages), stages):
            rows.append((name, stage, ran, reason, spark.read.parquet(s.output).count()))
    return spark.createDataFrame(rows, "pipeline string, stage string, ran boolean, reason string, n_rows bigint")
