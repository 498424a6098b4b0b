"""Readers of the raw files, with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUMMARIES = "wiki_id bigint, freebase_id string, title string, author string, pub_date string, genres string, summary string"
BOOKS = "book_id string, work_id string, title string, title_without_series string, description string, language_code string, authors array<struct<author_id: string, role: string>>, popular_shelves array<struct<name: string, count: string>>"
BOOK_AUTHORS = "book_id string, authors array<struct<author_id: string, role: string>>"
WORKS = "work_id string, original_publication_year string, media_type string"


def read_summaries(spark: SparkSession, path: str, quoted: bool = True) -> DataFrame:
    """A headerless table separated by tabs; ``quoted`` turns quoting on. Malformed lines are left out."""
    reader = spark.read.schema(SUMMARIES).option("sep", "\t").option("mode", "DROPMALFORMED")
    return (reader if quoted else reader.option("quote", "")).csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: str = BOOKS, strict: bool = False, partitions: int | None = None) -> DataFrame:
    """One object a line, plain or gzip; bad lines fail or are left out.

    Only the fields of the schema are parsed. A gzip file is one task, so its rows can be
    spread over ``partitions`` afterwards.
    """
    found = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    return found if partitions is None else found.repartition(partitions)


def read_book_authors(spark: SparkSession, path: str) -> DataFrame:
    """``book_id, author_ids`` of a file of books; nothing else of a line is parsed."""
    return read_json_lines(spark, path, BOOK_AUTHORS).select("book_id", F.col("authors.author_id").alias("author_ids"))


def read_book_columns(spark: SparkSession, pattern: str) -> DataFrame:
    """CSV files with a header: ``id, authors, ratingdisttotal``, by any of their spellings.

    Bytes that are no UTF-8 come as replacement characters, as the decoder reads them.
    """
    found = spark.read.option("header", True).option("escape", '"').csv(pattern)
    names = {c.lower(): c for c in found.columns}
    return found.select(F.col(names["id"]).cast("bigint").alias("id"), F.col(names["authors"]).alias("authors"), F.col(names["ratingdisttotal"]).alias("ratingdisttotal"))


def read_group_titles(spark: SparkSession, path: str) -> DataFrame:
    """``grp, title, size`` from headings such as ``## Group 3: Title (12 authors)``; the first definition counts."""
    pattern = r"^\W*(?:group\s*)?(\d+)\s*[:.\-–—|]\s*\**(.+?)\**\s*(?:[(|]\s*(\d+)[^)|]*[)|]?)?\s*$"
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    found = lines.select("at", *[F.regexp_extract("value", "(?i)" + pattern, i).alias(n) for i, n in ((1, "g"), (2, "title"), (3, "size"))]).where("g <> ''")
    first = found.groupBy("g").agg(F.min(F.struct("at", "title", "size")).alias("r"))
    return first.select(F.col("g").cast("int").alias("grp"), "r.title", F.when(F.col("r.size") != "", F.col("r.size")).cast("int").alias("size"))


def missing_inputs(spark: SparkSession, sizes: dict[str, int]) -> DataFrame:
    """``path, expected, found, complete`` for files and their sizes in bytes (0: any)."""
    rows = []
    for path, expected in sizes.items():
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        found = fs.getContentSummary(p).getLength() if fs.exists(p) else -1
        rows.append((path, expected, found, found >= 0 and (expected == 0 or found == expected)))
    return spark.createDataFrame(rows, "path string, expected bigint, found bigint, complete boolean")
