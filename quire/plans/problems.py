"""Queries of the numbered problems that belong to the core."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.languages import language_of_code
from ..functions.latin import LATIN_ACCENTS, LATIN_PLAIN
from ..operators.matching import match_records
from ..operators.representatives import top_per_group
from ..operators.sampling import permutation_sample
from ..operators.shared_spans import shared_pairs, shared_share
from ..operators.terms import distinct_records, term_frequencies
from ..runtime import table
from . import registry
from .registry import query

SAMPLE_SIZE, DECADE_SAMPLE_SIZE = 1000, 50

_WORKS_SQL = """
works as (
  select b.work_id, b.first_batch, w.year, cast(floor(w.year / 10) * 10 as int) as decade from
  (select work_id, min(batch) as first_batch from goodreads_books where work_id is not null group by work_id) b
  left join (select work_id, max(case when y between 1000 and 2100 then y end) as year from
    (select work_id, try_cast(regexp_extract(original_publication_year, '^\\s*([0-9]{4})(?:[^0-9].*)?$', 1) as int) as y from goodreads_book_works) group by work_id) w
  on b.work_id = w.work_id)"""

_PLACE_SQL = "md5('{seed}:' || cast(work_id as varchar))"


def _works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every work once, with its first batch, year and decade."""
    books = table(spark, sf_dir, "goodreads_books").where("work_id is not null").groupBy("work_id").agg(F.min("batch").alias("first_batch"))
    year = F.regexp_extract("original_publication_year", r"^\s*([0-9]{4})(?:[^0-9].*)?$", 1)
    years = table(spark, sf_dir, "goodreads_book_works").select("work_id", F.when(year != "", year).cast("int").alias("y")).groupBy("work_id").agg(F.max(F.when(F.col("y").between(1000, 2100), F.col("y"))).alias("year"))
    return books.join(years, "work_id", "left").withColumn("decade", (F.floor(F.col("year") / 10) * 10).cast("int"))


@query("p6_sample", f"""with {_WORKS_SQL},
placed as (select 'all' as stratum, *, {_PLACE_SQL.format(seed=6)} as place from works
  union all select coalesce(cast(decade as varchar), 'unknown'), *, {_PLACE_SQL.format(seed=60)} from works),
ranked as (select *, row_number() over (partition by stratum order by place, work_id) as position from placed)
select stratum, position, work_id, first_batch, year, decade from ranked
where position <= case when stratum = 'all' then {SAMPLE_SIZE} else {DECADE_SAMPLE_SIZE} end""")
def p6_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of fixed size of the works, overall and for every decade."""
    works = _works(spark, sf_dir)
    overall = permutation_sample(works, "work_id", SAMPLE_SIZE, seed=6)
    decades = permutation_sample(works, "work_id", DECADE_SAMPLE_SIZE, F.coalesce(F.col("decade").cast("string"), F.lit("unknown")), seed=60)
    return overall.unionByName(decades).select("stratum", F.col("position").cast("bigint").alias("position"), "work_id", "first_batch", "year", "decade")


_TERMS_SQL = r"""with records as (
  select 'b' || book_id as id, max(description) as text from goodreads_books where book_id is not null group by book_id
  union all select 'w' || wiki_id, max(summary) from booksummaries where wiki_id is not null group by wiki_id),
words as (select id, unnest(regexp_extract_all(lower(text), '\p{L}+')) as term from records),
counted as (select term, count(*) as occurrences, count(distinct id) as records from words group by term),
marked as (select term, occurrences, records, case when records <= 2 then 'rare'
  when records > 0.25 * (select count(distinct id) from words) then 'common' end as mark from counted)
"""


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = distinct_records(table(spark, sf_dir, "goodreads_books"), "book_id", "description")
    summaries = distinct_records(table(spark, sf_dir, "booksummaries"), "wiki_id", "summary")
    return term_frequencies(books.unionByName(summaries))


@query("p7_found", _TERMS_SQL + "select term, mark from marked where mark is not null")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of summaries and descriptions that are too rare or too common."""
    return _terms(spark, sf_dir).where("mark is not null").select("term", "mark")


@query("p7_terms", _TERMS_SQL + "select * from marked")
def p7_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All terms of summaries and descriptions with their counts and mark."""
    return _terms(spark, sf_dir)


@query("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of different works whose descriptions share 200 consecutive characters."""
    pairs = shared_pairs(table(spark, sf_dir, "goodreads_books"), "book_id", "work_id", "description", 200)
    return pairs.select(F.col("id_a").alias("book_id_a"), F.col("id_b").alias("book_id_b"))


@query("p3_share")
def p3_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each description stands in the descriptions of other works."""
    return shared_share(table(spark, sf_dir, "goodreads_books"), "book_id", "work_id", "description", 200).withColumnRenamed("id", "book_id")


_STOP_WORDS = {
    "en": "the and of is in that with to by for",
    "fr": "le la les et des une est dans que qui",
    "de": "der die das und ist nicht ein mit von den",
    "es": "el la los y una es en que con del",
    "pt": "o os e uma em que com não do da",
    "it": "il che di e una è non per del gli",
    "nl": "de het een van en is niet op dat met",
}


def _stop_word_language(books: DataFrame, texts: DataFrame) -> DataFrame:
    """A plain stand-in for the language hook: the language with most stop words."""
    words = F.split(F.lower("text"), r"[^\p{L}]+")
    among = lambda known: F.size(F.filter(words, lambda w: w.isin(known)))
    counts = [F.struct(among(v.split()).alias("n"), F.lit(k).alias("lang")) for k, v in _STOP_WORDS.items()]
    return texts.select("id", F.greatest(*counts)["lang"].alias("lang"))


@query("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every work the record with the best description and the one with the best label."""
    books = table(spark, sf_dir, "goodreads_books")
    columns = ["work_id", "description", "language_code", "updated_at"]
    records = books.where("book_id is not null").groupBy("book_id").agg(F.max(F.struct(*columns)).alias("r")).select("book_id", "r.*").where("work_id is not null")
    works = records.groupBy("work_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("work_id")
    words = F.size(F.filter(F.split("description", r"(?U)\s+"), lambda w: w != ""))
    fit = records.where(words >= 8).select("book_id", "work_id", "updated_at", F.length("description").alias("n_chars"))
    if "residue" in registry.hooks:
        fit = fit.join(registry.hooks["residue"](books), "book_id", "left_anti")
    newest = F.col("updated_at").desc_nulls_last()
    best = top_per_group(fit, "work_id", [F.col("n_chars").desc(), newest, F.col("book_id")]).join(works, "work_id").select("work_id", F.col("book_id").alias("description_book_id"))
    texts = best.join(records.select(F.col("book_id").alias("description_book_id"), "description"), "description_book_id").select(F.col("work_id").alias("id"), F.col("description").alias("text"))
    spoken = registry.hooks.get("language", _stop_word_language)(books, texts).select(F.col("id").alias("work_id"), "lang")
    labelled = records.select("book_id", "work_id", "updated_at", language_of_code(F.col("language_code")).alias("code")).where("code is not null")
    named = labelled.join(spoken, (labelled["work_id"] == spoken["work_id"]) & (labelled["code"] == spoken["lang"])).select(labelled["work_id"], "book_id", "updated_at")
    language = top_per_group(named, "work_id", [newest, F.col("book_id")]).select("work_id", F.col("book_id").alias("language_book_id"))
    zero = F.lit(0).cast("bigint")
    return works.join(best, "work_id", "left").join(language, "work_id", "left").select("work_id", F.coalesce("description_book_id", zero).alias("description_book_id"), F.coalesce("language_book_id", zero).alias("language_book_id"))


_NUMBERS = {"one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5"}


def _folded(text) -> Column:
    """Lower case without the accents of Latin letters."""
    return F.translate(F.lower(text), LATIN_ACCENTS, LATIN_PLAIN)


def _title_words(text) -> Column:
    return F.filter(F.split(F.regexp_replace(_folded(text), "['’]", ""), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 2)


def _text_names(text) -> Column:
    return F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\p{Lu}(?<![\p{L}\p{N}].)\p{L}{2,})"), F.lit(1))), _folded)


def _volume(text) -> Column:
    """The volume a title names, as a number or a word for a sequel; null where none."""
    low = F.lower(text)
    number = F.regexp_extract(low, r"(?:#|\b(?:volume|vol\.?|book|part|band|tome|tomo|deel)\s+)(\d+|one|two|three|four|five|six|i{1,3}|iv|v)\b", 1)
    words = F.create_map(*[F.lit(x) for kv in _NUMBERS.items() for x in kv])
    roman = F.regexp_extract(low, r"\s(ii|iii|iv|v)\W*$", 1)
    number = F.when(number != "", number).otherwise(roman)
    return F.when(number != "", F.coalesce(F.try_element_at(words, number), number)).when(low.rlike(r"\breturns\W*$|\bsequel\b|\bcontinued\b"), "sequel")


def _exploded(df: DataFrame, **attributes) -> DataFrame:
    parts = [df.select("id", F.lit(name).alias("attr"), F.explode(words).alias("token")) for name, words in attributes.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    year_of = lambda c: F.regexp_extract(c, r"(?<!\d)(1[5-9]\d\d|20[0-2]\d)(?!\d)", 1)
    wiki = table(spark, sf_dir, "booksummaries").where("wiki_id is not null").select(F.col("wiki_id").alias("id"), "summary", "title", "author", "pub_date")
    left = _exploded(wiki, title=_title_words(F.col("title")), person=_title_words(F.col("author")), name=_text_names(F.col("summary")))
    left_info = wiki.select("id", F.when(year_of("pub_date") != "", year_of("pub_date")).cast("int").alias("year"), _volume(F.col("title")).alias("volume")).groupBy("id").agg(F.max("year").alias("year"), F.max("volume").alias("volume"))
    books = table(spark, sf_dir, "goodreads_books").where("work_id is not null").select(F.col("work_id").alias("id"), "title", "title_without_series", "description", "authors")
    editions = _exploded(books.select("id", "title_without_series"), title=_title_words(F.col("title_without_series")))
    names = _exploded(books.select("id", "description"), name=_text_names(F.col("description")))
    people = books.select("id", F.explode("authors.author_id").alias("author_id")).distinct().join(table(spark, sf_dir, "author_id_names").select("author_id", "name"), "author_id")
    persons = _exploded(people.select("id", "name"), person=_title_words(F.col("name")))
    right = editions.unionByName(names).unionByName(persons)
    volumes = books.select("id", _volume(F.col("title")).alias("volume")).distinct().groupBy("id").agg(F.collect_set("volume").alias("volumes"))
    years = table(spark, sf_dir, "goodreads_book_works").groupBy(F.col("work_id").alias("id")).agg(F.max(year_of("original_publication_year")).alias("y"))
    right_info = volumes.join(years, "id", "left").select("id", F.when(F.col("y") != "", F.col("y")).cast("int").alias("year"), "volumes")
    return match_records(left, right, left_info, right_info)


@query("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The work that is the same book, for the books of booksummaries that have one."""
    return _matches(spark, sf_dir).select(F.col("left_id").alias("wiki_id"), F.col("right_id").alias("work_id"))


@query("p2_matches")
def p2_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same matches with their confidence and evidence."""
    return _matches(spark, sf_dir).withColumnsRenamed({"left_id": "wiki_id", "right_id": "work_id"})
