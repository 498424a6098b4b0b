"""Words that mark a label, shelves as genres, and the cost of removing flagged sentences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import table
from .bounding_queries import _FLAGS_SQL, flags
from .corpus_queries import _ROWS_SQL, tfidf
from .registry import query
from .text_queries import _GENRES_SQL, _STOP, BOOKS_SQL, SUMMARIES_SQL, genre_rows, summaries

_WORDS = "list_filter(regexp_extract_all(lower(summary), '[a-z]+'), lambda w: length(w) > 2 and w not in ({s}))".format(s=_STOP)


@query("discriminating_words", f"""with {SUMMARIES_SQL}, {_GENRES_SQL}, t as (select wiki_id, unnest({_WORDS}) as word from books where summary is not null),
tf as (select wiki_id, word, 1 + ln(count(*)) as tf from t group by all), idf as (select word, ln((1 + (select count(distinct wiki_id) from t)) / (1.0 + count(*))) + 1 as idf from tf group by word),
v as (select wiki_id, word, tf * idf as w from tf join idf using (word)), nv as (select wiki_id, word, w / sqrt(sum(w * w) over (partition by wiki_id)) as w from v),
g as (select distinct wiki_id, genre from genre_rows where wiki_id in (select wiki_id from nv)), size as (select genre, count(*) as n from g group by genre having count(*) >= 20), tot as (select count(distinct wiki_id) as n from nv),
allw as (select word, sum(w) as s from nv group by word), ing as (select genre, word, sum(w) as s from nv join g using (wiki_id) join size using (genre) group by genre, word),
d as (select genre, word, ing.s / size.n - (allw.s - ing.s) / nullif(tot.n - size.n, 0) as delta from ing join allw using (word) join size using (genre), tot)
select genre, word, round(delta, 6) as delta from (select *, row_number() over (partition by genre order by round(delta, 9) desc, word) as k from d) where k <= 20""")
def discriminating_words(spark, sf_dir):
    """The words whose mean weight inside a genre exceeds that outside most."""
    found = F.filter(F.regexp_extract_all(F.lower("summary"), F.lit("([a-z]+)"), F.lit(1)), lambda w: (F.length(w) > 2) & ~w.isin(*T.STOP_WORDS))
    nv = tfidf(summaries(spark, sf_dir).where("summary is not null").select("wiki_id", F.explode(found).alias("word")), "wiki_id", "word")
    docs = nv.select("wiki_id").distinct()
    g = genre_rows(spark, sf_dir).select("wiki_id", "genre").distinct().join(docs, "wiki_id")
    size = g.groupBy("genre").agg(F.count(F.lit(1)).alias("n")).where("n >= 20")
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    inside = nv.join(g, "wiki_id").join(size, "genre").groupBy("genre", "word").agg(F.sum("weight").alias("s"), F.max("n").alias("n"))
    whole = nv.groupBy("word").agg(F.sum("weight").alias("all"))
    delta = F.col("s") / F.col("n") - (F.col("all") - F.col("s")) / F.nullif(F.col("total") - F.col("n"), F.lit(0))
    d = inside.join(whole, "word").crossJoin(F.broadcast(total)).select("genre", "word", delta.alias("delta"))
    order = Window.partitionBy("genre").orderBy(F.round("delta", 9).desc(), "word")
    return d.withColumn("k", F.row_number().over(order)).where("k <= 20").select("genre", "word", F.round("delta", 6).alias("delta"))


#: A small vocabulary of the shelves of these tables; a shelf may stand for several genres.
SHELF_GENRES = {"fiction": ["fantasy", "romance", "mystery", "horror", "thriller"], "crime": ["mystery", "thriller"], "travel": ["travel"], "verse": ["poetry"], "thought": ["philosophy"]}
_VOCABULARY = [(shelf, genre) for genre, shelves in SHELF_GENRES.items() for shelf in shelves]
_VOCABULARY_SQL = "vocabulary as (select * from (values " + ", ".join(f"('{s}', '{g}')" for s, g in _VOCABULARY) + ") as t(shelf, genre)), split as (select *, 1.0::double / count(*) over (partition by shelf) as part from vocabulary)"


@query("shelf_genres", f"""with {_VOCABULARY_SQL}, b as (select book_id, any_value(popular_shelves) as ss from goodreads_books where book_id is not null group by book_id), x as (select book_id, s.name as shelf, coalesce(try_cast(s.count as bigint), 0) as n from (select book_id, unnest(ss) as s from b)),
v as (select book_id, genre, sum(n * part) as votes from x join split using (shelf) group by all), t as (select book_id, sum(votes) as total from v group by book_id having sum(votes) >= 5)
select book_id, genre, round(votes / total, 6) as share from v join t using (book_id)""")
def shelf_genres(spark, sf_dir):
    """Genre distribution of each book: a shelf's votes are split evenly over its genres."""
    vocabulary = spark.createDataFrame(_VOCABULARY, "shelf string, genre string")
    split = vocabulary.join(vocabulary.groupBy("shelf").agg((1.0 / F.count(F.lit(1))).alias("part")), "shelf")
    books = table(spark, sf_dir, "goodreads_books").where("book_id is not null").groupBy("book_id").agg(F.first("popular_shelves").alias("ss"))
    x = books.select("book_id", F.explode("ss").alias("s")).select("book_id", F.col("s.name").alias("shelf"), F.coalesce(F.expr("try_cast(s.count as bigint)"), F.lit(0)).alias("n"))
    v = x.join(F.broadcast(split), "shelf").groupBy("book_id", "genre").agg(F.sum(F.col("n") * F.col("part")).alias("votes"))
    t = v.groupBy("book_id").agg(F.sum("votes").alias("total")).where("total >= 5")
    return v.join(t, "book_id").select("book_id", "genre", F.round(F.col("votes") / F.col("total"), 6).alias("share"))


@query("removed_share", f"with {BOOKS_SQL}, {_ROWS_SQL}, {_FLAGS_SQL}, r as (select len(rules) as n_rules, sum(length(sentence)) as chars from flags group by 1), c as (select n_rules, sum(chars) over (order by n_rules desc) as above, sum(chars) over () as total from r) select n_rules::int as n_rules, round(above / total, 6)::double as share from c")
def removed_share(spark, sf_dir):
    """Share of all characters in sentences that at least so many rules flag."""
    r = flags(spark, sf_dir).select(F.size("rules").alias("n_rules"), F.length("sentence").alias("chars")).groupBy("n_rules").agg(F.sum("chars").alias("chars"))
    # one row for each number of rules, so the running sum is over a handful of rows
    running, whole = Window.partitionBy(F.lit(0)).orderBy(F.desc("n_rules")), Window.partitionBy(F.lit(0))
    return r.select("n_rules", F.round(F.sum("chars").over(running) / F.sum("chars").over(whole), 6).alias("share"))
