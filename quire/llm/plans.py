"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import registry
from ..runtime import table
from .languages import fit_languages, label_stretches, main_language, missing_or_wrong
from .leaks import find_leaks
from .packing import pack
from .residue import exclude_residue, find_residue
from .splitting import split_oversized


def _limit(spark: SparkSession, sf_dir: str, purpose: str) -> tuple[int, int]:
    row = table(spark, sf_dir, "token_limits").where(F.col("purpose") == purpose).first()
    return int(row["max_tokens"]), int(row["overlap_tokens"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records whose description is or contains template residue."""
    return find_residue(table(spark, sf_dir, "goodreads_books"), "book_id", "description").select("book_id")


def p1_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of residue each record holds, and where."""
    return find_residue(table(spark, sf_dir, "goodreads_books"), "book_id", "description")


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of goodreads_books without residue."""
    return exclude_residue(table(spark, sf_dir, "goodreads_books"), "book_id", "description").select("book_id", "work_id", "batch")


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = table(spark, sf_dir, "goodreads_books")
    return missing_or_wrong(books, "book_id", "description", "language_code", find_residue(books, "book_id", "description").select("book_id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every stretch where the label is missing, wrong or too coarse."""
    return _languages(spark, sf_dir).where("lang is not null").select("book_id", "segment", "lang")


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same stretches with their place, confidence and the label they correct."""
    return _languages(spark, sf_dir)


def _residue_ids(books: DataFrame) -> DataFrame:
    return find_residue(books, "book_id", "description").select("book_id")


def _main_language(books: DataFrame, texts: DataFrame) -> DataFrame:
    return main_language(label_stretches(texts, fit_languages(books, "book_id", "description", "language_code")))


registry.hooks["residue"] = _residue_ids
registry.hooks["language"] = _main_language


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents in containers of the 'pack' size."""
    return pack(table(spark, sf_dir, "documents"), "doc_id", "text", _limit(spark, sf_dir, "pack")[0])


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a passage of a held-out text, with the item."""
    return find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p10_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every text of documents above the 'split' size."""
    return split_oversized(table(spark, sf_dir, "documents"), "doc_id", "text", *_limit(spark, sf_dir, "split"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents above the 'split' size, as the splitter finds them."""
    return p10_split(spark, sf_dir).where(F.col("piece") == 1).select("doc_id")


def queries() -> dict:
    return {"p1_found": p1_found, "p1_residue": p1_residue, "p1_clean": p1_clean, "p5_found": p5_found, "p5_segments": p5_segments, "p8_pack": p8_pack, "p9_found": p9_found, "p10_found": p10_found, "p10_split": p10_split}


def oracle_sql() -> dict[str, str]:
    return {}
