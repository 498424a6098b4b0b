"""Checks on topics and trends: what is an artifact, what a slope can claim, how wide a band is."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import stats as S
from ..operators.sampling import permutation_sample
from ..runtime import table
from . import registry
from .corpus_queries import phi_association
from .registry import query
from .text_queries import _GENRES_SQL, _STAT_NAMES, _STATS_SQL, SUMMARIES_SQL, genre_rows, summaries, summary_stats
from .trend_queries import _PRED_SQL, _t, predictions, profile, topic_weights
from .word_queries import discriminating_words

#: Words of a topic that speak of the book as an object, and words of blurbs in general.
BIBLIOGRAPHIC = ["edition", "published", "publisher", "volume", "pages", "author", "illustrated", "translated", "reprint", "copyright"]
GENERIC = ["novel", "book", "story", "tells", "follows", "plot", "introduction", "summary", "reader", "life"]

#: Top words of a topic that are looked at, and how many markers make it an artifact.
TOP_WORDS, MIN_MARKERS = 8, 3


_RENORM_SQL = """renorm as (select wiki_id, decade, genre, w / sum(w) over (partition by wiki_id) as w from w where genre <> 'Novel'
  qualify sum(w) over (partition by wiki_id) > 0.01),
raw_slope as (select genre, 100 * 10 * regr_slope(mean, decade) as raw from prof where decade <= 2000 group by genre),
re_slope as (select genre, 100 * 10 * regr_slope(mean, decade) as renormalised from (select decade, genre, avg(w) as mean from renorm group by decade, genre) where decade <= 2000 group by genre)"""


@query("claimable_slopes", _t(f""", {_RENORM_SQL} select genre, round(raw, 6) as raw, round(renormalised, 6) as renormalised,
  coalesce(sign(round(raw, 9)) = sign(round(renormalised, 9)) and abs(renormalised - raw) < abs(raw) / 2 and abs(raw) >= 0.1, false) as claimable from raw_slope join re_slope using (genre)"""))
def claimable_slopes(spark, sf_dir):
    """Slopes in points of share a decade, raw and without the excluded topic, and whether they may be claimed."""
    weights = topic_weights(spark, sf_dir)
    kept = weights.where("genre <> 'Novel'")
    rest = kept.groupBy("wiki_id").agg(F.sum("w").alias("rest")).where("rest > 0.01")
    renormalised = S.period_profile(kept.join(rest, "wiki_id").withColumn("w", F.col("w") / F.col("rest")), "decade", "genre", "w")
    raw, re = (S.slopes(p, "decade", "genre").select("genre", (100 * F.col("slope")).alias(name)) for p, name in ((profile(spark, sf_dir), "raw"), (renormalised, "renormalised")))
    same = F.sign(F.round("raw", 9)) == F.sign(F.round("renormalised", 9))
    claim = same & (F.abs(F.col("renormalised") - F.col("raw")) < F.abs("raw") / 2) & (F.abs("raw") >= 0.1)
    return raw.join(re, "genre").select("genre", F.round("raw", 6).alias("raw"), F.round("renormalised", 6).alias("renormalised"), F.coalesce(claim, F.lit(False)).alias("claimable"))


@query("share_half_width", _t(""", b as (select *, mean / nullif(lift, 0) as base from lifted where lift > 0)
select decade, genre, round(((mean + half) / base - (mean - half) / base) / 2 / lift * mean, 6) as half_width from b"""))
def share_half_width(spark, sf_dir):
    """Half width of the share, from the band of the lift."""
    s = S.lift(profile(spark, sf_dir), "genre").where("lift > 0").withColumn("base", F.col("mean") / F.col("lift"))
    hi, lo = (F.col("mean") + F.col("half")) / F.col("base"), (F.col("mean") - F.col("half")) / F.col("base")
    return s.select("decade", "genre", F.round((hi - lo) / 2 / F.col("lift") * F.col("mean"), 6).alias("half_width"))


@query("movers_order", _t(""", s as (select genre, round(max(mean) - min(mean), 9) as spread from prof group by genre)
select genre, round(spread, 6) as spread, row_number() over (order by spread desc, genre) as rank from s"""))
def movers_order(spark, sf_dir):
    """Topics by the distance between their largest and their smallest share."""
    s = profile(spark, sf_dir).groupBy("genre").agg(F.round(F.max("mean") - F.min("mean"), 9).alias("spread"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("spread"), "genre")  # one row a topic
    return s.select("genre", F.round("spread", 6).alias("spread"), F.row_number().over(order).cast("bigint").alias("rank"))


@query("trend_leaders", _t(""", s as (select genre, round(sum(mean), 9) as total from prof group by genre)
select genre, round(total, 6) as total from s order by s.total desc, genre limit 8"""))
def trend_leaders(spark, sf_dir):
    """The eight topics with the largest sum of shares over the decades."""
    s = profile(spark, sf_dir).groupBy("genre").agg(F.round(F.sum("mean"), 9).alias("t"))
    return s.orderBy(F.desc("t"), "genre").limit(8).select("genre", F.round("t", 6).alias("total"))


_WORDS_SQL = registry._SQL["discriminating_words"]
_TOP_SQL = f"""disc as ({_WORDS_SQL}),
ranked as (select genre, word, row_number() over (partition by genre order by delta desc, word) as k from disc),
marks as (select genre, count(*) filter (where word in ({','.join(repr(x) for x in BIBLIOGRAPHIC)})) as bibliographic, count(*) filter (where word in ({','.join(repr(x) for x in GENERIC)})) as generic from ranked where k <= {TOP_WORDS} group by genre),
artifacts as (select *, case when bibliographic >= {MIN_MARKERS} then 'bibliographic' when generic >= {MIN_MARKERS} then 'generic' end as reason from marks)"""


def _artifacts(spark, sf_dir):
    order = Window.partitionBy("genre").orderBy(F.desc("delta"), "word")
    top = discriminating_words(spark, sf_dir).withColumn("k", F.row_number().over(order)).where(F.col("k") <= TOP_WORDS)
    marks = top.groupBy("genre").agg(F.count_if(F.col("word").isin(BIBLIOGRAPHIC)).alias("bibliographic"), F.count_if(F.col("word").isin(GENERIC)).alias("generic"))
    return marks.withColumn("reason", F.when(F.col("bibliographic") >= MIN_MARKERS, "bibliographic").when(F.col("generic") >= MIN_MARKERS, "generic"))


@query("artifact_topics", f"with {_TOP_SQL} select * from artifacts")
def artifact_topics(spark, sf_dir):
    """Topics whose top words speak of the book as an object or of blurbs in general."""
    return _artifacts(spark, sf_dir)


@query("artifact_share", _t(f""", {_TOP_SQL}, s as (select decade, sum(w) as total, sum(case when reason = 'bibliographic' then w else 0 end) as bibliographic, sum(case when reason = 'generic' then w else 0 end) as generic
  from w left join artifacts using (genre) group by decade)
select decade, round(bibliographic / total, 6) as bibliographic, round(generic / total, 6) as generic, round((bibliographic + generic) / total, 6) as artifact from s"""))
def artifact_share(spark, sf_dir):
    """Share of the weight of each decade that artifact topics hold, by reason and in all."""
    w = topic_weights(spark, sf_dir).join(_artifacts(spark, sf_dir).select("genre", "reason"), "genre", "left")
    part = lambda r: F.sum(F.when(F.col("reason") == r, F.col("w")).otherwise(0.0))
    s = w.groupBy("decade").agg(F.sum("w").alias("total"), part("bibliographic").alias("b"), part("generic").alias("g"))
    share = lambda c: F.round(c / F.col("total"), 6)
    return s.select("decade", share(F.col("b")).alias("bibliographic"), share(F.col("g")).alias("generic"), share(F.col("b") + F.col("g")).alias("artifact"))


_CLUSTER_SQL = """c as (select decade as cluster, genre, count(*) as n from genre_rows where decade is not null group by all),
k as (select *, row_number() over (partition by cluster order by n desc, genre) as k, sum(n) over (partition by cluster) as labels from c)"""


def _clusters(spark, sf_dir):
    """Counts of labels in clusters (here the decades), ranked."""
    c = genre_rows(spark, sf_dir).where("decade is not null").groupBy(F.col("decade").alias("cluster"), "genre").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("cluster")
    return c.withColumn("k", F.row_number().over(whole.orderBy(F.desc("n"), "genre"))).withColumn("labels", F.sum("n").over(whole))


@query("cluster_labels", f"with {SUMMARIES_SQL}, {_GENRES_SQL}, {_CLUSTER_SQL} select cluster, genre, k as rank, round(n / labels, 6)::double as share from k where k <= 6")
def cluster_labels(spark, sf_dir):
    """The six most frequent labels of each cluster with their share."""
    return _clusters(spark, sf_dir).where("k <= 6").select("cluster", "genre", F.col("k").cast("bigint").alias("rank"), F.round(F.col("n") / F.col("labels"), 6).alias("share"))


@query("overall_purity", f"with {SUMMARIES_SQL}, {_GENRES_SQL}, {_CLUSTER_SQL} select count(distinct cluster) as clusters, round(sum(n) filter (where k = 1) / sum(n), 6)::double as purity from k")
def overall_purity(spark, sf_dir):
    """Share of all labels that are the most frequent one of their cluster."""
    k = _clusters(spark, sf_dir)
    return k.agg(F.countDistinct("cluster").alias("clusters"), F.round(F.sum(F.when(F.col("k") == 1, F.col("n"))) / F.sum("n"), 6).alias("purity"))


def _describe_sql(c: str) -> str:
    quarters = ", ".join(f"round(quantile_cont({c}::double, {q / 100}), 6) as p{q}" for q in (25, 50, 75))
    return f"select '{c}' as stat, count({c}) as n, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as sd, min({c})::double as lo, {quarters}, round(max({c})::double, 6) as hi from stats"


@query("describe_all", f"with {SUMMARIES_SQL}, {_STATS_SQL} " + " union all ".join(_describe_sql(c) for c in _STAT_NAMES).replace("min(", "round(min(").replace(")::double as lo", ")::double, 6) as lo"))
def describe_all(spark, sf_dir):
    """Count, mean, deviation, extremes and quartiles of all seven statistics."""
    stats = summary_stats(spark, sf_dir).select(F.explode(F.array(*[F.struct(F.lit(c).alias("stat"), F.col(c).cast("double").alias("x")) for c in _STAT_NAMES])).alias("r")).select("r.*")
    q = F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    r = lambda c: F.round(c, 6)
    found = stats.groupBy("stat").agg(F.count("x").alias("n"), r(F.avg("x")).alias("mean"), r(F.stddev_samp("x")).alias("sd"), r(F.min("x")).alias("lo"), q.alias("q"), r(F.max("x")).alias("hi"))
    return found.select("stat", "n", "mean", "sd", "lo", *[r(F.col("q")[i]).alias(f"p{p}") for i, p in enumerate((25, 50, 75))], "hi")


_LINE_SQL = f"""{SUMMARIES_SQL}, {_STATS_SQL}, m as (select regr_slope(year, word_count) as b, regr_intercept(year, word_count) as a from stats),
e as (select year - (a + b * word_count) as error from stats, m), s as (select min(error) as lo, max(error) as hi from e)"""


@query("error_histogram", f"with {_LINE_SQL} select least(floor((error - lo) / ((hi - lo) / 50)), 49)::int as bin, count(*) as n from e, s group by bin")
def error_histogram(spark, sf_dir):
    """Errors of a straight line from the word count to the year in fifty bins."""
    s = summary_stats(spark, sf_dir).select("year", "word_count")
    m = s.agg(F.regr_slope(F.col("year"), F.col("word_count")).alias("b"), F.regr_intercept(F.col("year"), F.col("word_count")).alias("a"))
    e = s.crossJoin(F.broadcast(m)).select((F.col("year") - (F.col("a") + F.col("b") * F.col("word_count"))).alias("error"))
    span = e.agg(F.min("error").alias("lo"), F.max("error").alias("hi"))
    at = F.least(F.floor((F.col("error") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 50)), F.lit(49)).cast("int")
    return e.crossJoin(F.broadcast(span)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("threshold_grid", f"""with {_PRED_SQL}, z as (select truth, score + length(label) / 100.0::double as score from pred), q as (select quantile_cont(score, 0.1) as lo, quantile_cont(score, 0.9) as hi from z),
t as (select i::int as step, lo + (hi - lo) * i / 59.0 as threshold from q, (select unnest(range(0, 60)) as i)),
c as (select step, any_value(threshold) as threshold, sum((score >= threshold)::int * truth) as tp, sum((score >= threshold)::int) as flagged, sum(truth) as positives from z, t group by step),
f as (select step, threshold, tp / nullif(flagged, 0)::double as precision, tp / nullif(positives, 0)::double as recall, 2 * tp / nullif(flagged + positives, 0)::double as f1 from c)
select step, round(threshold, 6) as threshold, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, step = (select min(step) from f where round(f1, 9) = (select max(round(f1, 9)) from f)) as best from f""")
def threshold_grid(spark, sf_dir):
    """Micro precision, recall and F1 at sixty thresholds between the tenth and the ninetieth percentile, with the best."""
    z = predictions(spark, sf_dir).select("truth", (F.col("score") + F.length("label") / 100.0).alias("score"))
    q = z.agg(F.percentile("score", F.array(F.lit(0.1), F.lit(0.9))).alias("q"))
    # counts by score first: the sixty thresholds meet one row a score
    counts = z.groupBy("score").agg(F.sum("truth").alias("p"), F.count(F.lit(1)).alias("n"))
    t = counts.crossJoin(F.broadcast(q)).select("score", "p", "n", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("step"), "q")
    t = t.withColumn("threshold", F.col("q")[0] + (F.col("q")[1] - F.col("q")[0]) * F.col("step") / 59.0)
    hit = F.col("score") >= F.col("threshold")
    c = t.groupBy("step").agg(F.max("threshold").alias("threshold"), F.sum(F.when(hit, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("flagged"), F.sum("p").alias("positives"))
    none = lambda x: F.nullif(x, F.lit(0))
    f = c.select("step", "threshold", (F.col("tp") / none(F.col("flagged"))).alias("precision"), (F.col("tp") / none(F.col("positives"))).alias("recall"), (2 * F.col("tp") / none(F.col("flagged") + F.col("positives"))).alias("f1"))
    best = f.agg(F.max_by("step", F.struct(F.round("f1", 9), -F.col("step"))).alias("top"))
    return f.crossJoin(F.broadcast(best)).select("step", *[F.round(x, 6).alias(x) for x in ("threshold", "precision", "recall", "f1")], (F.col("step") == F.col("top")).alias("best"))


_PAIRWISE_SQL = registry._SQL["pairwise_cosine"]


@query("pooled_cosine", f"with g as ({_PAIRWISE_SQL}) select count(*) as groups, round(sum(similarity * n * (n - 1)) / sum(n * (n - 1)), 5) as pooled from g where n > 1")
def pooled_cosine(spark, sf_dir):
    """Mean cosine over the pairs of all groups together."""
    g = S.mean_pairwise_cosine(table(spark, sf_dir, "embeddings"), "label", "embedding", 64).where("n > 1").withColumn("pairs", F.col("n") * (F.col("n") - 1))
    return g.agg(F.count(F.lit(1)).alias("groups"), F.round(F.sum(F.col("similarity") * F.col("pairs")) / F.sum("pairs"), 5).alias("pooled"))


_PLACE = "md5('{seed}:' || cast({key} as varchar))"


def _sample_sql(source: str, key: str, k: int, seed: int, columns: str) -> str:
    return f"select {columns} from (select *, row_number() over (order by {_PLACE.format(seed=seed, key=key)}, {key}) as position from {source}) where position <= {k}"


@query("plane_sample", _sample_sql("embeddings", "vec_id", 4000, 3, "vec_id, label, round(embedding[1]::double, 6) as x, round(embedding[2]::double, 6) as y"))
def plane_sample(spark, sf_dir):
    """At most four thousand points of the plane, drawn uniformly."""
    drawn = permutation_sample(table(spark, sf_dir, "embeddings"), "vec_id", 4000, seed=3)
    return drawn.select("vec_id", "label", *[F.round(F.col("embedding")[i].cast("double"), 6).alias(n) for i, n in enumerate("xy")])


@query("smoke_sample", f"with {SUMMARIES_SQL} " + _sample_sql("books", "wiki_id", 200, 11, "wiki_id, title, position"))
def smoke_sample(spark, sf_dir):
    """Two hundred summaries for a quick run, drawn uniformly."""
    return permutation_sample(summaries(spark, sf_dir), "wiki_id", 200, seed=11).select("wiki_id", "title", F.col("position").cast("bigint").alias("position"))


@query("head_sample", f"with {SUMMARIES_SQL} select wiki_id, title from books order by wiki_id limit 700")
def head_sample(spark, sf_dir):
    """The first seven hundred summaries by id."""
    return summaries(spark, sf_dir).select("wiki_id", "title").orderBy("wiki_id").limit(700)


@query("test_titles", f"with {SUMMARIES_SQL}, t as (select wiki_id, title, row_number() over (order by wiki_id) - 1 as position from books where substring({_PLACE.format(seed=42, key='wiki_id')}, 1, 1) < '3') select position, wiki_id, title from t")
def test_titles(spark, sf_dir):
    """Titles of the held-out part by their position in it."""
    from ..operators.sampling import random_key

    held = summaries(spark, sf_dir).where(F.substring(random_key(F.col("wiki_id"), 42), 1, 1) < "3").select("wiki_id", "title")
    # positions by ranges: each task numbers its own rows after those of the ranges before it
    placed = held.repartitionByRange("wiki_id").withColumn("_p", F.spark_partition_id())
    starts = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy("wiki_id"))
    return placed.withColumn("_r", inside).join(F.broadcast(starts), "_p").select((F.col("_before") + F.col("_r") - 1).alias("position"), "wiki_id", "title")


@query("report_cells", _t(", c as (select decade, genre, mean from prof) select decade, genre, cast(round(100 * mean, 1) as varchar) || '%' as share, case when length(genre) > 12 then substr(genre, 1, 11) || '…' else genre end as label from c"))
def report_cells(spark, sf_dir):
    """Shares as percentages and labels cut to twelve characters, as tables of a report show them."""
    label = F.when(F.length("genre") > 12, F.concat(F.substring("genre", 1, 11), F.lit("…"))).otherwise(F.col("genre"))
    return profile(spark, sf_dir).select("decade", "genre", F.concat(F.round(100 * F.col("mean"), 1).cast("string"), F.lit("%")).alias("share"), label.alias("label"))


@query("vocabulary_overlap", f"""with {SUMMARIES_SQL}, t as (select distinct substring({_PLACE.format(seed=5, key='wiki_id')}, 1, 1) < '8' as part, unnest(regexp_extract_all(lower(summary), '[a-z]+')) as word from books where summary is not null),
s as (select word, count(*) as parts from t group by word) select count(*) as union_size, count(*) filter (where parts = 2) as shared, round(count(*) filter (where parts = 2) / count(*), 6)::double as share from s""")
def vocabulary_overlap(spark, sf_dir):
    """Words of two halves of the corpus: their union, what both have, and its share."""
    from ..operators.sampling import random_key

    part = F.substring(random_key(F.col("wiki_id"), 5), 1, 1) < "8"
    t = summaries(spark, sf_dir).where("summary is not null").select(part.alias("part"), F.explode(F.regexp_extract_all(F.lower("summary"), F.lit("([a-z]+)"), F.lit(1))).alias("word"))
    s = t.groupBy("word").agg(F.max("part").alias("a"), F.min("part").alias("b"))
    both = F.count_if(F.col("a") != F.col("b"))
    return s.agg(F.count(F.lit(1)).alias("union_size"), both.alias("shared"), F.round(both / F.count(F.lit(1)), 6).alias("share"))


#: Words whose register is known: of praise, and of plots.
REFERENCE_WORDS = {"praise": ["novel", "author", "bestselling", "reader", "story"], "plot": ["house", "night", "town", "river", "door"]}
_KNOWN = ", ".join(f"('{w}', '{k}')" for k, ws in REFERENCE_WORDS.items() for w in ws)


@query("phi_calibration", f"with phis as ({registry._SQL['phi_association']}), known as (select * from (values {_KNOWN}) as t(word, register)) select register, phis.* from phis join known using (word)")
def phi_calibration(spark, sf_dir):
    """Association of words whose register is known, to set the limits of the tiers by."""
    found = phi_association(spark, sf_dir)
    register = F.coalesce(*[F.when(F.col("word").isin(ws), k) for k, ws in REFERENCE_WORDS.items()])
    return found.withColumn("register", register).where("register is not null")
