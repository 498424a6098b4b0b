"""Text statistics, predicates, frequencies and trends over the book tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import table
from .registry import query

_STOP = ",".join(f"'{w}'" for w in T.STOP_WORDS)

#: DuckDB's words between white space.
_W = "list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> '')"

SUMMARIES_SQL = r"""summaries as (select wiki_id, max(title) as title, max(summary) as summary, max(pub_date) as pub_date, max(genres) as genres from booksummaries where wiki_id is not null group by wiki_id),
dated as (select *, cast(nullif(regexp_extract(pub_date, '\b(1[5-9]\d{2}|20\d{2})\b', 1), '') as int) as y from summaries),
books as (select wiki_id, title, summary, pub_date, genres, case when y <= 2019 then y end as year,
  case when y <= 2019 then cast(floor(y / 10) * 10 as int) end as decade from dated)"""


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every summary once, with year and decade."""
    raw = table(spark, sf_dir, "booksummaries").where("wiki_id is not null")
    one = raw.groupBy("wiki_id").agg(*[F.max(c).alias(c) for c in ("title", "summary", "pub_date", "genres")])
    return one.withColumn("year", T.year_in(F.col("pub_date"))).withColumn("decade", T.decade("year"))


def _bare(c: str) -> str:
    return f"regexp_replace(lower({c}), '[!-/:-@\\[-`{{-~]', ' ', 'g')"


_STATS_SQL = f"""stats as (select wiki_id, year, decade, length(summary) as char_count, len(ws) as word_count, len(uq) as unique_words,
  len(uq) / cast(nullif(len(ws), 0) as double) as lexical_diversity, length(array_to_string(ws, '')) / cast(nullif(len(ws), 0) as double) as avg_word_len,
  sn as sentence_count, len(ws) / cast(nullif(sn, 0) as double) as avg_sent_len from
  (select *, {_W.format(c='summary')} as ws, list_distinct(list_filter({_W.format(c=_bare('summary'))}, lambda w: w not in ({_STOP}))) as uq,
   len(list_filter(regexp_split_to_array(summary, '[.!?]+'), lambda s: trim(s) <> '')) as sn from books where length(trim(summary)) > 50 and year between 1900 and 2019))"""

_STAT_NAMES = ["char_count", "word_count", "unique_words", "lexical_diversity", "avg_word_len", "sentence_count", "avg_sent_len"]


def summary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = summaries(spark, sf_dir).where("length(trim(summary)) > 50 and year between 1900 and 2019")
    return kept.select("wiki_id", "year", "decade", *[c.alias(n) for n, c in T.text_stats("summary").items()])


@query("text_stats_by_bucket", f"with {SUMMARIES_SQL}, {_STATS_SQL} select decade, count(*) as n, " + ", ".join(f"round(avg({c}), 6) as mean_{c}" for c in _STAT_NAMES) + " from stats group by decade")
def text_stats_by_bucket(spark, sf_dir):
    """Mean of every text statistic by decade."""
    return summary_stats(spark, sf_dir).groupBy("decade").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in _STAT_NAMES])


@query("text_stats", f"with {SUMMARIES_SQL}, {_STATS_SQL} select wiki_id, " + ", ".join(f"round(cast({c} as double), 6) as {c}" for c in _STAT_NAMES) + " from stats")
def text_stats(spark, sf_dir):
    """Seven statistics of every summary."""
    return summary_stats(spark, sf_dir).select("wiki_id", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in _STAT_NAMES])


@query("describe_stats", f"with {SUMMARIES_SQL}, {_STATS_SQL} " + " union all ".join(f"select '{c}' as stat, count({c}) as n, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as sd, cast(min({c}) as double) as lo, cast(quantile_cont({c}, 0.5) as double) as median, cast(max({c}) as double) as hi from stats" for c in ("char_count", "word_count", "sentence_count")))
def describe_stats(spark, sf_dir):
    """Descriptive summary of the counts."""
    names = ("char_count", "word_count", "sentence_count")
    long = summary_stats(spark, sf_dir).select(F.explode(F.array(*[F.struct(F.lit(c).alias("stat"), F.col(c).alias("v")) for c in names])).alias("x")).select("x.*")
    return long.groupBy("stat").agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("sd"), F.min("v").cast("double").alias("lo"), F.percentile("v", 0.5).alias("median"), F.max("v").cast("double").alias("hi"))


@query("year_extract", f"with {SUMMARIES_SQL} select wiki_id, year, decade, case when y2 <= 2017 then y2 end as year_strict from (select *, cast(nullif(regexp_extract(pub_date, '\\b(1[5-9]\\d{{2}}|20\\d{{2}})\\b', 1), '') as int) as y2 from books)")
def year_extract(spark, sf_dir):
    """Years by the two patterns, and the decade."""
    return summaries(spark, sf_dir).select("wiki_id", "year", "decade", T.year_in(F.col("pub_date"), 2017).alias("year_strict"))


_GENRES_SQL = r"""genre_rows as (select wiki_id, year, decade, unnest(map_values(coalesce(try_cast(try_cast(genres as json) as map(varchar, varchar)),
  try_cast(try_cast(regexp_replace(regexp_replace(genres, '([{ ,:])''', '\1"', 'g'), '''([,:}])', '"\1', 'g') as json) as map(varchar, varchar))))) as genre from books)"""


def genre_rows(spark, sf_dir):
    return summaries(spark, sf_dir).select("wiki_id", "year", "decade", F.explode(T.genre_names(F.col("genres"))).alias("genre"))


@query("json_map_values", f"with {SUMMARIES_SQL}, {_GENRES_SQL} select wiki_id, genre from genre_rows")
def json_map_values(spark, sf_dir):
    """Genres of every summary, from JSON maps and from literals."""
    return genre_rows(spark, sf_dir).select("wiki_id", "genre")


@query("genre_frequency", f"with {SUMMARIES_SQL}, {_GENRES_SQL} select genre, count(*) as n from genre_rows group by genre having count(*) >= 5 order by n desc, genre limit 12")
def genre_frequency(spark, sf_dir):
    """The twelve most frequent genres."""
    return genre_rows(spark, sf_dir).groupBy("genre").agg(F.count(F.lit(1)).alias("n")).where("n >= 5").orderBy(F.desc("n"), "genre").limit(12)


@query("genre_share_by_decade", f"with {SUMMARIES_SQL}, {_GENRES_SQL}, sizes as (select decade, count(*) as books from books where decade is not null and wiki_id in (select wiki_id from genre_rows) group by decade) select g.decade, g.genre, round(count(distinct wiki_id) / cast(any_value(books) as double), 6) as share from genre_rows g join sizes s on g.decade = s.decade group by g.decade, g.genre")
def genre_share_by_decade(spark, sf_dir):
    """Share of the books of a decade that carry each genre."""
    rows = genre_rows(spark, sf_dir).where("decade is not null")
    sizes = rows.groupBy("decade").agg(F.countDistinct("wiki_id").alias("books"))
    return rows.groupBy("decade", "genre").agg(F.countDistinct("wiki_id").alias("n")).join(sizes, "decade").select("decade", "genre", F.round(F.col("n") / F.col("books"), 6).alias("share"))


_ENCODED = ["Fantasy", "Mystery", "Novel", "Science fiction"]


@query("one_hot_labels", f"with {SUMMARIES_SQL}, {_GENRES_SQL}, sets as (select wiki_id, list(genre) as gs from genre_rows group by wiki_id) select * from (select wiki_id, " + ", ".join(f"cast(list_contains(gs, '{g}') as int) as genre_{g.lower().replace(' ', '_')}" for g in _ENCODED) + " from sets) where " + " + ".join(f"genre_{g.lower().replace(' ', '_')}" for g in _ENCODED) + " > 0")
def one_hot_labels(spark, sf_dir):
    """Label columns of the books that have any of them."""
    genres = summaries(spark, sf_dir).select("wiki_id", T.genre_names(F.col("genres")).alias("gs"))
    encoded = genres.select("wiki_id", *[F.array_contains("gs", g).cast("int").alias("genre_" + g.lower().replace(" ", "_")) for g in _ENCODED])
    return encoded.where(" + ".join(encoded.columns[1:]) + " > 0")


_KEYWORDS = ["war", "love", "murder", "family", "river gate"]


@query("keyword_rate", f"with {SUMMARIES_SQL}, t as (select decade, ' ' || lower(summary) || ' ' as s, len({_W.format(c='summary')}) as n from books where decade is not null and summary is not null) " + " union all ".join(f"select decade, '{k}' as keyword, round(sum((length(s) - length(replace(s, ' {k} ', ''))) / {len(k) + 2}) / sum(n) * 10000, 6) as per_10k from t group by decade having sum(n) > 0" for k in _KEYWORDS))
def keyword_rate(spark, sf_dir):
    """Occurrences of keywords for each ten thousand words of a decade."""
    t = summaries(spark, sf_dir).where("decade is not null and summary is not null").select("decade", F.concat(F.lit(" "), F.lower("summary"), F.lit(" ")).alias("s"), F.size(T.words(F.col("summary"))).alias("n"))
    hits = [F.sum((F.length("s") - F.length(F.replace(F.col("s"), F.lit(f" {k} "), F.lit("")))) / F.lit(float(len(k) + 2))).alias(k) for k in _KEYWORDS]
    wide = t.groupBy("decade").agg(F.sum("n").alias("words"), *hits).where("words > 0")
    return wide.select("decade", F.explode(F.array(*[F.struct(F.lit(k).alias("keyword"), F.round(F.col(f"`{k}`") / F.col("words") * 10000, 6).alias("per_10k")) for k in _KEYWORDS])).alias("x")).select("decade", "x.*")


@query("year_histogram", f"with {SUMMARIES_SQL} select least(greatest(cast(floor((year - 1900) / 2.0) as int) + 1, 0), 61) as bin, count(*) as n from books where year is not null group by 1")
def year_histogram(spark, sf_dir):
    """Sixty bins of publication years."""
    year = summaries(spark, sf_dir).where("year is not null")
    return year.select(F.width_bucket(F.col("year").cast("double"), F.lit(1900.0), F.lit(2020.0), F.lit(60)).cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("class_floor", f"with {SUMMARIES_SQL} select wiki_id, decade from (select *, count(*) over (partition by decade) as c from books where decade is not null) where c >= 5")
def class_floor(spark, sf_dir):
    """Rows of the classes with at least five members."""
    rows = summaries(spark, sf_dir).where("decade is not null").select("wiki_id", "decade")
    sizes = rows.groupBy("decade").agg(F.count(F.lit(1)).alias("c")).where("c >= 5")
    return rows.join(sizes.select("decade"), "decade", "left_semi").select("wiki_id", "decade")


BOOKS_SQL = """records as (select book_id, max(work_id) as work_id, max(title) as title, max(title_without_series) as title_without_series, max(description) as description, max(language_code) as language_code,
  max(updated_at) as updated_at from goodreads_books where book_id is not null group by book_id)"""


def records(spark, sf_dir, *columns):
    """Every edition record once."""
    raw = table(spark, sf_dir, "goodreads_books").where("book_id is not null")
    return raw.groupBy("book_id").agg(*[F.max(c).alias(c) for c in (columns or ("work_id", "title", "title_without_series", "description", "language_code", "updated_at"))])


@query("english_filter", f"""with {BOOKS_SQL}, c as (select book_id, lower(trim(coalesce(language_code, ''))) as code, description, regexp_extract_all(lower(description), '[a-z'']+') as ws from records)
select book_id, (code in ('', 'en', 'eng') or starts_with(code, 'en-')) as code_ok,
  coalesce(not regexp_matches(description, '[\\x{{0370}}-\\x{{1FFF}}\\x{{3040}}-\\x{{9FFF}}\\x{{AC00}}-\\x{{D7AF}}]') and len(ws) >= 8 and len(list_filter(ws, lambda w: w in ({_STOP}))) / cast(greatest(len(ws), 1) as double) >= 0.1, false) as text_ok from c""")
def english_filter(spark, sf_dir):
    """Which records are English by their code and by their text."""
    return records(spark, sf_dir, "language_code", "description").select("book_id", T.is_english_code(F.col("language_code")).alias("code_ok"), F.coalesce(T.looks_english(F.col("description")), F.lit(False)).alias("text_ok"))


@query("html_strip", f"with {BOOKS_SQL} select book_id, regexp_replace(description, '<[^>]+>', ' ', 'g') as plain from records where length(description) >= 80 and contains(description, '<')")
def html_strip(spark, sf_dir):
    """Descriptions of at least 80 characters without their markup."""
    return records(spark, sf_dir, "description").where((F.length("description") >= 80) & F.contains("description", F.lit("<"))).select("book_id", T.strip_tags(F.col("description")).alias("plain"))


@query("clean_text", f"with {BOOKS_SQL} select book_id, array_to_string(list_filter({_W.format(c=_bare('description'))}, lambda w: w not in ({_STOP})), ' ') as cleaned from records where description is not null")
def clean_text(spark, sf_dir):
    """Descriptions as lower case words without punctuation and stop words."""
    return records(spark, sf_dir, "description").where("description is not null").select("book_id", T.clean_text(F.col("description")).alias("cleaned"))


@query("book_works", r"""select work_id, cast(regexp_extract(original_publication_year, '\b(1[5-9]\d{2}|20\d{2})\b', 1) as int) as year from goodreads_book_works
where lower(trim(coalesce(media_type, ''))) in ('', 'book') and regexp_extract(original_publication_year, '\b(1[5-9]\d{2}|20\d{2})\b', 1) <> '' and cast(nullif(regexp_extract(original_publication_year, '\b(1[5-9]\d{2}|20\d{2})\b', 1), '') as int) <= 2017""")
def book_works(spark, sf_dir):
    """Works that are books, with a valid first year."""
    works = table(spark, sf_dir, "goodreads_book_works")
    is_book = F.lower(F.trim(F.coalesce("media_type", F.lit("")))).isin("", "book")
    return works.where(is_book).select("work_id", T.year_in(F.col("original_publication_year"), 2017).alias("year")).where("year is not null")


@query("works_with_years", f"""with {BOOKS_SQL}, y as (select work_id, cast(nullif(regexp_extract(original_publication_year, '\\b(1[5-9]\\d{{2}}|20\\d{{2}})\\b', 1), '') as int) as year from goodreads_book_works)
select book_id, r.work_id, year, cast(floor(year / 10) * 10 as int) as decade from records r join y on r.work_id = y.work_id where year <= 2017 and length(description) >= 80 and year >= 1900""")
def works_with_years(spark, sf_dir):
    """Records joined with the first year of their work, from 1900."""
    years = table(spark, sf_dir, "goodreads_book_works").select("work_id", T.year_in(F.col("original_publication_year"), 2017).alias("year"))
    return records(spark, sf_dir, "work_id", "description").where("length(description) >= 80").join(years.where("year >= 1900"), "work_id").select("book_id", "work_id", "year", T.decade("year").alias("decade"))


@query("first_per_work", f"with {BOOKS_SQL} select coalesce(work_id, book_id) as key, min(book_id) as book_id from records where length(description) >= 80 group by 1")
def first_per_work(spark, sf_dir):
    """The first eligible record of each work; a record without a work stands for itself."""
    return records(spark, sf_dir, "work_id", "description").where("length(description) >= 80").groupBy(F.coalesce("work_id", "book_id").alias("key")).agg(F.min("book_id").alias("book_id"))


@query("stratified_sample", f"""with {BOOKS_SQL}, d as (select book_id, cast(floor(cast(nullif(regexp_extract(w.original_publication_year, '\\b(1[5-9]\\d{{2}}|20\\d{{2}})\\b', 1), '') as int) / 10) * 10 as int) as decade from records r join goodreads_book_works w on r.work_id = w.work_id)
select decade, book_id from (select *, row_number() over (partition by decade order by md5('42:' || book_id), book_id) as k from d where decade is not null) where k <= 25""")
def stratified_sample(spark, sf_dir):
    """At most 25 records of every decade, in the order of a seeded digest."""
    from ..operators.sampling import permutation_sample

    years = table(spark, sf_dir, "goodreads_book_works").select("work_id", T.decade(T.year_in(F.col("original_publication_year"), 2099)).alias("decade")).where("decade is not null")
    rows = records(spark, sf_dir, "work_id").join(years, "work_id").select("book_id", "decade")
    return permutation_sample(rows, "book_id", 25, F.col("decade"), seed=42).select("decade", "book_id")


@query("train_test_split", f"with {SUMMARIES_SQL} select wiki_id, decade, case when k <= ceil(n * 0.2) then 'test' else 'train' end as part from (select wiki_id, decade, row_number() over (partition by decade order by md5('42:' || wiki_id), wiki_id) as k, count(*) over (partition by decade) as n from books where decade is not null)")
def train_test_split(spark, sf_dir):
    """A repeatable split that keeps one in five of every class for testing."""
    rows = summaries(spark, sf_dir).where("decade is not null").select("wiki_id", "decade")
    order = Window.partitionBy("decade").orderBy(F.md5(F.concat(F.lit("42:"), F.col("wiki_id").cast("string"))), "wiki_id")
    ranked = rows.withColumn("k", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("decade")))
    return ranked.select("wiki_id", "decade", F.when(F.col("k") <= F.ceil(F.col("n") * 0.2), "test").otherwise("train").alias("part"))
