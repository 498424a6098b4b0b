"""Keywords of the decades by ranks in the graph of words, and n-gram weights."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph
from ..runtime import cut, release
from .registry import query
from .text_queries import _STOP, SUMMARIES_SQL, summaries

#: Rounds of the ranks, and documents of a decade that a keyword must stand in.
ROUNDS, MIN_DOCS = 20, 3

_RANKED_SQL = f"""{SUMMARIES_SQL}, t as (select wiki_id as doc, decade, list_filter(regexp_extract_all(lower(summary), '[a-z]+'), lambda w: length(w) > 2 and w not in ({_STOP})) as ws from books where summary is not null and decade is not null),
r as (select doc, decade, unnest(range(0, len(ws)))::int as p, unnest(ws) as w, len(ws) as n from t),
near as (select x.decade, least(x.w, y.w) as a, greatest(x.w, y.w) as b, greatest(0, least(x.p, x.n - 4) - greatest(0, y.p - 3) + 1) as k from r x join r y on x.doc = y.doc and y.p > x.p and y.p <= x.p + 3 and x.w <> y.w),
edges as (select decade, a, b, sum(k)::bigint as weight from near group by all having sum(k) > 0),
sym as (select decade, a as n, b as o, weight from edges union all select decade, b, a, weight from edges),
degree as (select decade, n, sum(weight) as total from sym group by all), size as (select count(*)::double as every from degree),
steps as (select sym.decade, sym.n, o, weight / total as p from sym join degree using (decade, n)),
pr(i, decade, n, rank) as (select 0, decade, n, 1 / every from degree, size union all
  select * from (select any_value(i) + 1, decade, o, any_value(0.15 / every) + 0.85 * sum(rank * p) from pr join steps using (decade, n), size where i < {ROUNDS} group by decade, o)),
ranks as (select decade, n as word, rank * every / count(*) over (partition by decade) as rank from pr, size where i = {ROUNDS}),
df as (select decade, w as word, count(distinct doc) as docs, count(*) as c from r group by all), dn as (select decade, sum(c) as c from df group by decade),
whole as (select word, sum(c) as c from df group by word), wn as (select sum(c) as c from df),
kw as (select ranks.decade, ranks.word, round(rank, 9) as rank, docs, round(rank * ln(1 + (df.c / dn.c) / (whole.c / wn.c)), 9) as distinct_ from ranks join df using (decade, word) join dn using (decade) join whole using (word), wn),
top as (select decade, word, rank as score, 'rank' as kind, row_number() over (partition by decade order by rank desc, word) as k from kw
  union all select decade, word, distinct_, 'distinctive', row_number() over (partition by decade order by distinct_ desc, word) from kw where docs >= {MIN_DOCS})"""


def decade_words(spark, sf_dir):
    """``doc, decade, p, w``: content words of whole summaries with their position."""
    words = F.filter(F.regexp_extract_all(F.lower("summary"), F.lit("([a-z]+)"), F.lit(1)), lambda w: (F.length(w) > 2) & ~w.isin(*T.STOP_WORDS))
    dated = summaries(spark, sf_dir).where("summary is not null and decade is not null")
    return dated.select(F.col("wiki_id").alias("doc"), "decade", F.posexplode(words).alias("p", "w"))


@query("textrank_keywords", f"with recursive {_RANKED_SQL} select decade, kind, k as place, word, round(score, 7) as score from top where k <= 5")
def textrank_keywords(spark, sf_dir):
    """The five words of each decade that rank highest in its graph of words, and the five most its own."""
    tokens = cut(decade_words(spark, sf_dir))
    # one graph for all decades: a node is a word of a decade, and no tie leaves a decade
    node = F.concat(F.col("decade").cast("string"), F.lit("|"), F.col("w"))
    edges = graph.cooccurrence(tokens.select("doc", "p", node.alias("w")), "doc", "p", "w")
    ranks = graph.pagerank(edges, rounds=ROUNDS).select(F.substring_index("node", "|", 1).cast("int").alias("decade"), F.substring_index("node", "|", -1).alias("word"), "rank")
    # a decade's share of all nodes is taken out again
    sizes = ranks.groupBy("decade").agg(F.count(F.lit(1)).alias("nodes"))
    every = sizes.agg(F.sum("nodes").alias("every"))
    ranks = ranks.join(sizes, "decade").crossJoin(F.broadcast(every)).withColumn("rank", F.col("rank") * F.col("every") / F.col("nodes"))
    df = tokens.groupBy("decade", F.col("w").alias("word")).agg(F.countDistinct("doc").alias("docs"), F.count(F.lit(1)).alias("c"))
    of_decade = df.groupBy("decade").agg(F.sum("c").alias("in_decade"))
    of_word = df.groupBy("word").agg(F.sum("c").alias("in_all"))
    total = df.agg(F.sum("c").alias("all"))
    kw = ranks.join(df, ["decade", "word"]).join(of_decade, "decade").join(of_word, "word").crossJoin(F.broadcast(total))
    more = (F.col("c") / F.col("in_decade")) / (F.col("in_all") / F.col("all"))
    kw = cut(kw.select("decade", "word", "docs", F.round("rank", 9).alias("rank"), F.round(F.col("rank") * F.log(1 + more), 9).alias("own")))
    release(tokens)

    def best(rows, column, kind):
        order = Window.partitionBy("decade").orderBy(F.desc(column), "word")
        placed = rows.withColumn("place", F.row_number().over(order).cast("bigint")).where("place <= 5")
        return placed.select("decade", F.lit(kind).alias("kind"), "place", "word", F.round(column, 7).alias("score"))

    return best(kw, "rank", "rank").unionByName(best(kw.where(F.col("docs") >= MIN_DOCS), "own", "distinctive"))


def _weights_sql(grams: str, min_df: int, max_df: float) -> str:
    return f"""with {SUMMARIES_SQL}, g as ({grams}), docs as (select count(distinct wiki_id)::double as n from g), tf as (select wiki_id, gram, 1 + ln(count(*)) as tf from g group by all),
df as (select gram, count(*) as df from tf group by gram having count(*) >= {min_df} and count(*) <= {max_df} * (select n from docs)),
v as (select wiki_id, gram, tf * (ln((1 + n) / (1.0 + df)) + 1) as w from tf join df using (gram), docs),
u as (select wiki_id, gram, round(w / sqrt(sum(w * w) over (partition by wiki_id)), 9) as weight from v)
select wiki_id, gram, round(weight, 6) as weight, k as place from (select *, row_number() over (partition by wiki_id order by weight desc, gram) as k from u) where k <= 5"""


def gram_weights(grams, min_df: int, max_df: float):
    """``wiki_id, gram, weight``: sublinear TF-IDF of unit length over grams of at least ``min_df`` and at most ``max_df`` of the documents."""
    tf = grams.groupBy("wiki_id", "gram").agg((1 + F.log(F.count(F.lit(1)))).alias("tf"))
    docs = grams.agg(F.countDistinct("wiki_id").cast("double").alias("n"))
    df = tf.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(docs)).where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))
    v = tf.join(df, "gram").select("wiki_id", "gram", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = v.groupBy("wiki_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return v.join(norm, "wiki_id").select("wiki_id", "gram", F.round(F.col("w") / F.col("norm"), 9).alias("weight"))


def _heaviest(weights):
    order = Window.partitionBy("wiki_id").orderBy(F.desc("weight"), "gram")
    return weights.withColumn("place", F.row_number().over(order).cast("bigint")).where("place <= 5").withColumn("weight", F.round("weight", 6))


_WORD_GRAMS = f"""select wiki_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) as gram from
  (select wiki_id, list_filter(regexp_extract_all(lower(summary), '[a-z]+'), lambda w: length(w) > 1 and w not in ({_STOP})) as ws from books where summary is not null)"""


@query("word_ngram_tfidf", _weights_sql(_WORD_GRAMS, 2, 0.8))
def word_ngram_tfidf(spark, sf_dir):
    """The five heaviest words and pairs of words of each summary."""
    ws = F.filter(F.regexp_extract_all(F.lower("summary"), F.lit("([a-z]+)"), F.lit(1)), lambda w: (F.length(w) > 1) & ~w.isin(*T.STOP_WORDS))
    rows = summaries(spark, sf_dir).where("summary is not null").select("wiki_id", ws.alias("ws"))
    n = F.size("ws")
    pairs = F.when(n >= 2, F.zip_with(F.slice("ws", 1, n - 1), F.slice("ws", 2, n - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return _heaviest(gram_weights(rows.select("wiki_id", F.explode(F.concat("ws", pairs)).alias("gram")), 2, 0.8))


_CHAR_GRAMS = """select wiki_id, substr(w, i, k) as gram from (select wiki_id, ' ' || w || ' ' as w, unnest([3, 4, 5]) as k from
  (select wiki_id, unnest(regexp_extract_all(lower(summary), '[a-z]+')) as w from books where summary is not null)), lateral (select unnest(range(1, length(w) - k + 2)) as i)"""


@query("char_ngram_tfidf", _weights_sql(_CHAR_GRAMS, 2, 0.8))
def char_ngram_tfidf(spark, sf_dir):
    """The five heaviest runs of three to five characters inside the words of each summary."""
    w = F.concat(F.lit(" "), F.col("w"), F.lit(" "))
    words = summaries(spark, sf_dir).where("summary is not null").select("wiki_id", F.explode(F.regexp_extract_all(F.lower("summary"), F.lit("([a-z]+)"), F.lit(1))).alias("w"))
    # counts of words first: a word is cut once for each summary that has it
    counted = words.groupBy("wiki_id", "w").agg(F.count(F.lit(1)).alias("c"))
    runs = counted.select("wiki_id", "c", w.alias("w"), F.explode(F.array(*[F.lit(k) for k in (3, 4, 5)])).alias("k")).where(F.length("w") >= F.col("k"))
    grams = runs.select("wiki_id", "c", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - F.col("k") + 1), lambda i: F.substring("w", i, F.col("k")))).alias("gram"))
    tf = grams.groupBy("wiki_id", "gram").agg((1 + F.log(F.sum("c"))).alias("tf"))
    docs = counted.agg(F.countDistinct("wiki_id").cast("double").alias("n"))
    df = tf.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(docs)).where((F.col("df") >= 2) & (F.col("df") <= 0.8 * F.col("n")))
    # runs of characters and summaries grow with the input, so neither side of a join goes through the driver
    v = tf.join(df.hint("merge"), "gram").select("wiki_id", "gram", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = v.groupBy("wiki_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return _heaviest(v.join(norm.hint("merge"), "wiki_id").select("wiki_id", "gram", F.round(F.col("w") / F.col("norm"), 9).alias("weight")))
