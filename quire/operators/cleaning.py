"""Cleaning of text collections: duplicates, boilerplate and repeated sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise, sentences
from ..runtime import cut

#: Phrases of printers and scanners that stand in place of a description.
BOILERPLATE = [
    "converted from its physical edition", r"pre-19\d\d historical reproduction", "occasional imperfections", "republishing these classic works",
    "reproduction of a book published", "digitization process", "scanning process", "kindle edition includes wireless", "culturally important",
    "print on demand", "facsimile", "we have elected to bring", "original artifact", "quality assurance was conducted", "this book may have occasional",
    r"scanned (?:copy|image|version)", "optical character recognition",
]


def is_boilerplate(c) -> Column:
    return c.rlike("(?i)" + "|".join(BOILERPLATE))


def keep_first(df: DataFrame, key: Column, order: list[str], eligible: Column | None = None) -> DataFrame:
    """The first eligible row of every key; rows with a null key form no group."""
    from .representatives import top_per_group

    fit = df if eligible is None else df.where(eligible)
    return top_per_group(fit.withColumn("_key", key), "_key", [F.col(c) for c in order]).drop("_key")


def sentence_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, pos, sentence, key`` of every sentence."""
    return df.select(id_col, F.posexplode(sentences(F.col(text_col))).alias("pos", "sentence")).withColumn("key", normalise(F.col("sentence")))


def repeated_sentences(df: DataFrame, id_col: str, text_col: str, min_docs: int = 10, min_chars: int = 25) -> DataFrame:
    """``key, n_docs`` of the sentences that stand in at least ``min_docs`` texts."""
    rows = sentence_rows(df, id_col, text_col).where(F.length("key") >= min_chars)
    return rows.groupBy("key").agg(F.countDistinct(id_col).alias("n_docs")).where(F.col("n_docs") >= min_docs)


def strip_repeated(df: DataFrame, id_col: str, text_col: str, min_docs: int = 10, min_chars: int = 25) -> DataFrame:
    """``id, text, stripped_chars``: texts without the sentences repeated across texts, one row an id."""
    # a written table has a known size: the engine sends a small one to the tasks, and then no
    # sentence is shuffled; only the positions of what is repeated meet the texts again
    repeated = cut(repeated_sentences(df, id_col, text_col, min_docs, min_chars).select("key"))
    found = sentence_rows(df, id_col, text_col).join(repeated, "key").groupBy(id_col).agg(F.collect_set("pos").alias("_at"), F.sum(F.length("sentence")).alias("stripped_chars"))
    texts = df.where(F.size(sentences(F.col(text_col))) > 0).select(id_col, sentences(F.col(text_col)).alias("_s")).join(found, id_col, "left")
    kept = F.filter("_s", lambda s, i: ~F.coalesce(F.array_contains("_at", i), F.lit(False)))
    return texts.select(id_col, F.array_join(kept, " ").alias("text"), F.coalesce("stripped_chars", F.lit(0)).alias("stripped_chars"))


def clean_corpus(df: DataFrame, id_col: str, text_col: str, min_docs: int = 10, min_chars: int = 200, bound=None) -> DataFrame:
    """Boilerplate, exact and prefix duplicates, repeated sentences, an optional hook, length.

    The order matters: each step sees what the one before left. ``bound`` is a function of
    DataFrames ``(id, text, stripped_chars)``.
    """
    base = df.select(id_col, F.col(text_col).alias("text")).where(F.col("text").isNotNull() & ~is_boilerplate(F.col("text")))
    exact = keep_first(base, F.md5(normalise(F.col("text"))), [id_col])
    near = cut(keep_first(exact, F.substring(normalise(F.col("text")), 1, 120), [id_col]))
    stripped = strip_repeated(near, id_col, "text", min_docs)
    return (stripped if bound is None else bound(stripped)).where(F.length("text") >= min_chars)
