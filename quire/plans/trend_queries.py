"""Period tables, statistics and evaluation measures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import stats as S
from ..runtime import table
from .registry import query
from .text_queries import _GENRES_SQL, _STATS_SQL, SUMMARIES_SQL, genre_rows, summaries, summary_stats

# Genres as topics: each book spreads a weight of one evenly over its genres.
_TOPIC_SQL = f"""{SUMMARIES_SQL}, {_GENRES_SQL},
g as (select wiki_id, decade, genre from genre_rows where decade >= 1900 group by all), k as (select wiki_id, count(*) as n from g group by wiki_id),
docs as (select distinct wiki_id, decade from g), names as (select distinct genre from g),
w as (select d.wiki_id, d.decade, s.genre, case when g.genre is null then 0.0 else 1.0 / n end::double as w from docs d cross join names s left join g on g.wiki_id = d.wiki_id and g.genre = s.genre join k on k.wiki_id = d.wiki_id),
prof as (select decade, genre, avg(w) as mean, 1.96 * stddev_samp(w) / sqrt(count(*)) as half, count(*) as n from w group by decade, genre),
lifted as (select *, case when avg(mean) over (partition by genre) = 0 then 1 else mean / avg(mean) over (partition by genre) end as lift from prof)"""


def topic_weights(spark, sf_dir):
    """``wiki_id, decade, genre, w``: genre weights of every book, zeros included; genres are few."""
    g = genre_rows(spark, sf_dir).where("decade >= 1900").select("wiki_id", "decade", "genre").distinct()
    n = g.groupBy("wiki_id", "decade").agg(F.count(F.lit(1)).alias("n"), F.collect_set("genre").alias("own"))
    names = g.agg(F.sort_array(F.collect_set("genre")).alias("names"))
    both = n.crossJoin(F.broadcast(names)).select("wiki_id", "decade", "n", "own", F.explode("names").alias("genre"))
    return both.select("wiki_id", "decade", "genre", F.when(F.array_contains("own", F.col("genre")), 1.0 / F.col("n")).otherwise(0.0).alias("w"))


def profile(spark, sf_dir):
    return S.period_profile(topic_weights(spark, sf_dir), "decade", "genre", "w")


def _t(sql: str) -> str:
    return f"with {_TOPIC_SQL} {sql}"


@query("decade_profile", _t("select decade, genre, round(mean, 6) as mean, round(half, 6) as half, n from prof"))
def decade_profile(spark, sf_dir):
    """Mean share of each topic in each decade with its half width."""
    return profile(spark, sf_dir).select("decade", "genre", F.round("mean", 6).alias("mean"), F.round("half", 6).alias("half"), "n")


@query("lift_by_bucket", _t("select decade, genre, round(lift, 6) as lift from lifted"))
def lift_by_bucket(spark, sf_dir):
    """Share of a topic against the mean over decades."""
    return S.lift(profile(spark, sf_dir), "genre").select("decade", "genre", F.round("lift", 6).alias("lift"))


@query("prevalence", _t("select decade, genre, round(avg((w >= 0.05)::int), 6) as p05, round(avg((w >= 0.10)::int), 6) as p10, round(avg((w >= 0.20)::int), 6) as p20 from w group by decade, genre"))
def prevalence(spark, sf_dir):
    """Share of the books in which a topic has at least some weight."""
    share = lambda t: F.round(F.avg((F.col("w") >= t).cast("int")), 6)
    return topic_weights(spark, sf_dir).groupBy("decade", "genre").agg(share(0.05).alias("p05"), share(0.10).alias("p10"), share(0.20).alias("p20"))


@query("dominant_share", _t("select decade, genre, round(count(*) / sum(count(*)) over (partition by decade), 6)::double as share from (select wiki_id, decade, genre, row_number() over (partition by wiki_id order by w desc, genre) as k from w) where k = 1 group by decade, genre"))
def dominant_share(spark, sf_dir):
    """Share of the books whose heaviest topic it is."""
    top = topic_weights(spark, sf_dir).groupBy("wiki_id", "decade").agg(F.min(F.struct((-F.col("w")).alias("neg"), "genre"))["genre"].alias("genre"))
    counts = top.groupBy("decade", "genre").agg(F.count(F.lit(1)).alias("c"))
    return counts.join(counts.groupBy("decade").agg(F.sum("c").alias("all")), "decade").select("decade", "genre", F.round(F.col("c") / F.col("all"), 6).alias("share"))


@query("movers_lag", _t("select decade, genre, round(mean - lag(mean) over (partition by genre order by decade), 6) as delta, decade - lag(decade) over (partition by genre order by decade) as gap from prof"))
def movers_lag(spark, sf_dir):
    """Change of each topic from the decade before."""
    return S.movers(profile(spark, sf_dir), "decade", "genre").select("decade", "genre", F.round("delta", 6).alias("delta"), "gap")


@query("peak_span", _t(""", r as (select decade, genre, round(mean, 9) as mean, coalesce(half, 0) as half from prof), pk as (select genre, decade as peak, mean - half as fl from (select *, row_number() over (partition by genre order by mean desc, decade) as k from r) where k = 1),
f as (select r.genre, decade, peak, mean + half >= fl as ok, sum(case when mean + half >= fl then 0 else 1 end) over (partition by r.genre order by decade) as isle from r join pk using (genre))
select genre, peak, min(decade) as first, max(decade) as last from f where ok group by genre, peak, isle having peak between min(decade) and max(decade)"""))
def peak_span(spark, sf_dir):
    """Peak decade of each topic and the decades around it that it cannot be told from."""
    return S.peak_span(profile(spark, sf_dir).withColumn("mean", F.round("mean", 9)), "decade", "genre")


@query("min_max_scaled", _t("select decade, genre, round((mean - min(mean) over p) / case when max(mean) over p = min(mean) over p then 1 else max(mean) over p - min(mean) over p end, 6) as scaled from prof window p as (partition by genre)"))
def min_max_scaled(spark, sf_dir):
    """Shares of each topic scaled from 0 to 1."""
    return S.min_max(profile(spark, sf_dir), "genre").select("decade", "genre", F.round("scaled", 6).alias("scaled"))


@query("regr_slope_by_term", _t("select genre, round(regr_slope(mean, decade) * 10, 6) as slope from prof where decade <= 2000 group by genre"))
def regr_slope_by_term(spark, sf_dir):
    """Change of each topic over a decade by least squares."""
    return S.slopes(profile(spark, sf_dir), "decade", "genre").select("genre", F.round("slope", 6).alias("slope"))


@query("top_topics", _t("select decade, genre, k as rank from (select decade, genre, row_number() over (partition by decade order by round(mean, 9) desc, genre) as k from prof) where k <= 3"))
def top_topics(spark, sf_dir):
    """The three largest topics of each decade."""
    w = Window.partitionBy("decade").orderBy(F.round("mean", 9).desc(), "genre")
    return profile(spark, sf_dir).withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 3").select("decade", "genre", "rank")


@query("significant_topics", _t(", s as (select decade, genre, lift, (mean - half) / nullif(mean, 0) * lift as lo from lifted), r as (select *, row_number() over (partition by decade order by round(lift, 9) desc, genre) as k, count(*) over (partition by decade) as c from s where lo > 1) select decade, genre, round(lift, 6) as lift, k as rank, greatest(c - 4, 0) as further from r where k <= 4"))
def significant_topics(spark, sf_dir):
    """Up to four topics of a decade whose lift is surely above one, and how many more there are."""
    s = S.lift(profile(spark, sf_dir), "genre").withColumn("lo", (F.col("mean") - F.col("half")) / F.nullif(F.col("mean"), F.lit(0.0)) * F.col("lift")).where("lo > 1")
    w = Window.partitionBy("decade").orderBy(F.round("lift", 9).desc(), "genre")
    r = s.withColumn("rank", F.row_number().over(w).cast("bigint")).withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("decade")))
    return r.where("rank <= 4").select("decade", "genre", F.round("lift", 6).alias("lift"), "rank", F.greatest(F.col("c") - 4, F.lit(0)).alias("further"))


@query("early_late", _t("select genre, round(avg(mean) filter (where decade <= 1940), 6) as early, round(avg(mean) filter (where decade >= 1960), 6) as late, round(max(mean) / nullif(min(mean) filter (where mean > 0), 0), 6) as ratio from prof group by genre"))
def early_late(spark, sf_dir):
    """Mean of the early and of the late decades, and the ratio of the extremes."""
    m = F.col("mean")
    return profile(spark, sf_dir).groupBy("genre").agg(F.round(F.avg(F.when(F.col("decade") <= 1940, m)), 6).alias("early"), F.round(F.avg(F.when(F.col("decade") >= 1960, m)), 6).alias("late"), F.round(F.max("mean") / F.nullif(F.min(F.when(m > 0, m)), F.lit(0.0)), 6).alias("ratio"))


@query("renormalised_shares", _t(", r as (select wiki_id, decade, genre, w, sum(w) over (partition by wiki_id) as rest from w where genre <> 'Novel') select wiki_id, genre, round(w / rest, 6) as w from r where rest > 0.01 and w > 0"))
def renormalised_shares(spark, sf_dir):
    """Weights without an excluded topic, scaled to one; books with almost nothing left are dropped."""
    kept = topic_weights(spark, sf_dir).where("genre <> 'Novel'")
    rest = kept.groupBy("wiki_id").agg(F.sum("w").alias("rest")).where("rest > 0.01")
    return kept.join(rest, "wiki_id").where("w > 0").select("wiki_id", "genre", F.round(F.col("w") / F.col("rest"), 6).alias("w"))


@query("bootstrap_lift")
def bootstrap_lift(spark, sf_dir):
    """Bootstrap bands of the lift of each topic in each decade."""
    return S.bootstrap_lift(topic_weights(spark, sf_dir), "wiki_id", "decade", "genre", "w")


@query("sparkline", _t(", s as (select decade, genre, (mean - min(mean) over p) / case when max(mean) over p = min(mean) over p then 1 else max(mean) over p - min(mean) over p end as z from prof window p as (partition by genre)) select genre, string_agg(cast(cast(floor(z * 7.999) as int) as varchar), '' order by decade) as line from s group by genre"))
def sparkline(spark, sf_dir):
    """The shares of each topic as eight levels in order of the decades."""
    s = S.min_max(profile(spark, sf_dir), "genre").select("genre", F.struct("decade", F.floor(F.col("scaled") * 7.999).cast("string").alias("v")).alias("x"))
    return s.groupBy("genre").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]), "").alias("line"))


_CORR = ["char_count", "word_count", "unique_words", "lexical_diversity", "avg_word_len", "sentence_count", "avg_sent_len"]
_RANK = "rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0"


@query("spearman", f"with {SUMMARIES_SQL}, {_STATS_SQL} " + " union all ".join(f"select '{c}' as feature, count(*) as n, round(corr(x, y), 6) as pearson, round(corr(rx, ry), 6) as spearman from (select x, y, {_RANK.format(c='x')} as rx, {_RANK.format(c='y')} as ry from (select {c}::double as x, year::double as y from stats where {c} is not null))" for c in _CORR))
def spearman(spark, sf_dir):
    """Correlation of the text statistics with the year."""
    found = S.correlations(summary_stats(spark, sf_dir), "year", _CORR)
    return found.select("feature", "n", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


# Measures on a rule that predicts each genre from words of the summary.
_RULES = {"Mystery": "murder|suspects|witness", "Fantasy": "curse|forged|tower", "Horror": "night|dies|body"}
_PRED_SQL = f"{SUMMARIES_SQL}, {_GENRES_SQL}, base as (select wiki_id, lower(summary) as s from books where summary is not null), pred as (" + " union all ".join(f"select wiki_id, '{g}' as label, (wiki_id in (select wiki_id from genre_rows where genre = '{g}'))::int as truth, len(regexp_extract_all(s, '{p}')) as score, regexp_matches(s, '{p}')::int as guess from base" for g, p in _RULES.items()) + ")"


def predictions(spark, sf_dir):
    g = genre_rows(spark, sf_dir).groupBy("wiki_id").agg(F.collect_set("genre").alias("own"))
    base = summaries(spark, sf_dir).where("summary is not null").select("wiki_id", F.lower("summary").alias("s")).join(g, "wiki_id", "left")
    rules = F.array(*[F.struct(F.lit(k).alias("label"), F.coalesce(F.array_contains("own", k), F.lit(False)).cast("int").alias("truth"), F.regexp_count("s", F.lit(p)).alias("score"), F.col("s").rlike(p).cast("int").alias("guess")) for k, p in _RULES.items()])
    return base.select("wiki_id", F.explode(rules).alias("r")).select("wiki_id", "r.*")


@query("micro_f1", f"with {_PRED_SQL}, c as (select label, sum(truth * guess) as tp, sum((1 - truth) * guess) as fp, sum(truth * (1 - guess)) as fn from pred group by label) select round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn))::double, 6) as micro_f1, round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 0)), 6) as macro_f1, round((sum(fp) + sum(fn))::double / (select count(*) from pred), 6) as hamming from c")
def micro_f1(spark, sf_dir):
    """Micro and macro F1 and Hamming loss."""
    rows = predictions(spark, sf_dir)
    scores = S.micro_macro(S.f1_scores(rows, "label", "truth", "guess"))
    return scores.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("cells")))).select(F.round("micro_f1", 6).alias("micro_f1"), F.round("macro_f1", 6).alias("macro_f1"), F.round(F.col("wrong") / F.col("cells"), 6).alias("hamming"))


@query("auc_rank", f"with {_PRED_SQL}, r as (select label, truth, rank() over (partition by label order by score) + (count(*) over (partition by label, score) - 1) / 2.0 as k from pred) select label, round((sum(k * truth) - sum(truth) * (sum(truth) + 1) / 2.0) / nullif(sum(truth) * sum(1 - truth), 0), 6)::double as auc from r group by label")
def auc_rank(spark, sf_dir):
    """Area under the ROC curve of each label's score."""
    rows, out = predictions(spark, sf_dir), None
    for label in _RULES:
        one = S.auc(rows.where(F.col("label") == label), "score", "truth").select(F.lit(label).alias("label"), F.round("auc", 6).alias("auc"))
        out = one if out is None else out.unionByName(one)
    return out


@query("confusion_matrix", f"with {_PRED_SQL}, t as (select a.label as truth, b.label as predicted, avg(b.guess) as share from pred a join pred b using (wiki_id) where a.truth = 1 and a.label <> b.label group by all) select truth, predicted, round(share, 6) as share from t")
def confusion_matrix(spark, sf_dir):
    """How often another label is predicted for the books of a label."""
    rows = predictions(spark, sf_dir)
    a, b = rows.where("truth = 1").select("wiki_id", F.col("label").alias("truth")), rows.select("wiki_id", F.col("label").alias("predicted"), "guess")
    return a.join(b, "wiki_id").where("truth <> predicted").groupBy("truth", "predicted").agg(F.round(F.avg("guess"), 6).alias("share"))


@query("threshold_sweep", f"with {_PRED_SQL}, q as (select unnest(range(0, 6)) as t) select t::int as threshold, round(sum((score >= t)::int * truth) / nullif(sum((score >= t)::int), 0)::double, 6) as precision, round(sum((score >= t)::int * truth) / nullif(sum(truth), 0)::double, 6) as recall from pred, q group by t")
def threshold_sweep(spark, sf_dir):
    """Precision and recall at each threshold of the score."""
    each = predictions(spark, sf_dir).select("truth", "score", F.explode(F.array(*[F.lit(i) for i in range(6)])).alias("threshold")).withColumn("hit", (F.col("score") >= F.col("threshold")).cast("int"))
    found = F.sum(F.col("hit") * F.col("truth"))
    return each.groupBy("threshold").agg(F.round(found / F.nullif(F.sum("hit"), F.lit(0)), 6).alias("precision"), F.round(found / F.nullif(F.sum("truth"), F.lit(0)), 6).alias("recall"))


@query("roc_points", f"with {_PRED_SQL}, c as (select label, score, sum(truth) as p, sum(1 - truth) as n from pred group by all) select label, score, round(sum(p) over w / nullif(sum(p) over (partition by label), 0), 6)::double as tpr, round(sum(n) over w / nullif(sum(n) over (partition by label), 0), 6)::double as fpr from c window w as (partition by label order by score desc)")
def roc_points(spark, sf_dir):
    """True and false positive rates at every score."""
    c = predictions(spark, sf_dir).groupBy("label", "score").agg(F.sum("truth").alias("p"), F.sum(1 - F.col("truth")).alias("n"))
    w, whole = Window.partitionBy("label").orderBy(F.desc("score")), Window.partitionBy("label")
    rate = lambda x: F.round(F.sum(x).over(w) / F.nullif(F.sum(x).over(whole), F.lit(0)), 6)
    return c.select("label", "score", rate("p").alias("tpr"), rate("n").alias("fpr"))


@query("regression_errors", f"with {SUMMARIES_SQL}, {_STATS_SQL}, m as (select regr_slope(year, word_count) as b, regr_intercept(year, word_count) as a, min(year) as lo, max(year) as hi from stats), p as (select year, least(greatest(a + b * word_count, lo), hi) as guess from stats, m) select round(avg(abs(year - guess)), 5) as mae, round(sqrt(avg((year - guess) * (year - guess))), 5) as rmse, round(1 - sum((year - guess) * (year - guess)) / (var_pop(year) * count(*)), 5) as r2 from p")
def regression_errors(spark, sf_dir):
    """Errors of a straight line from the word count to the year, clipped to the years seen."""
    s = summary_stats(spark, sf_dir).select("year", "word_count")
    m = s.agg(F.regr_slope(F.col("year"), F.col("word_count")).alias("b"), F.regr_intercept(F.col("year"), F.col("word_count")).alias("a"), F.min("year").alias("lo"), F.max("year").alias("hi"))
    guess = F.least(F.greatest(F.col("a") + F.col("b") * F.col("word_count"), F.col("lo")), F.col("hi"))
    found = S.regression_errors(s.crossJoin(F.broadcast(m)).withColumn("guess", guess), "year", "guess")
    return found.select(*[F.round(c, 5).alias(c) for c in ("mae", "rmse", "r2")])


@query("largest_errors", f"with {SUMMARIES_SQL}, {_STATS_SQL}, m as (select avg(year) as a from stats) select wiki_id, year, round(abs(year - a), 6) as error from stats, m order by error desc, wiki_id limit 10")
def largest_errors(spark, sf_dir):
    """The ten years farthest from the mean."""
    s = summary_stats(spark, sf_dir).select("wiki_id", "year")
    return s.crossJoin(F.broadcast(s.agg(F.avg("year").alias("a")))).select("wiki_id", "year", F.round(F.abs(F.col("year") - F.col("a")), 6).alias("error")).orderBy(F.desc("error"), "wiki_id").limit(10)


_COS_SQL = "e as (select label, list_transform(embedding, lambda x: x::double) as v from embeddings), u as (select label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) as u from e)"


@query("pairwise_cosine", f"with {_COS_SQL}, d as (select label, i, sum(u[i]) as s, count(*) as n from u, (select unnest(range(1, 65)) as i) group by label, i) select label, any_value(n) as n, round((sum(s * s) - any_value(n)) / nullif(any_value(n) * (any_value(n) - 1), 0), 6) as similarity from d group by label")
def pairwise_cosine(spark, sf_dir):
    """Mean cosine over the pairs of each group."""
    return S.mean_pairwise_cosine(table(spark, sf_dir, "embeddings"), "label", "embedding", 64).withColumn("similarity", F.round("similarity", 6))


@query("permutation_test")
def permutation_test(spark, sf_dir):
    """Coherence of each group against shuffled labels."""
    return S.permutation_test(table(spark, sf_dir, "embeddings"), "label", "embedding", 100)


@query("size_bands", "with s as (select l_orderkey, count(*) as size, sum(l_quantity) as q from lineitem group by 1), b as (select case when size <= 1 then '1' when size <= 4 then '2-4' when size <= 9 then '5-9' else '10+' end as band, q from s) select band, count(*) as n, round(median(q), 6) as median_q, round(avg((q > 100)::int), 6) as large from b group by band")
def size_bands(spark, sf_dir):
    """Groups in bands of size, with the median of a measure."""
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("size"), F.sum("l_quantity").alias("q"))
    band = F.when(F.col("size") <= 1, "1").when(F.col("size") <= 4, "2-4").when(F.col("size") <= 9, "5-9").otherwise("10+")
    return s.select(band.alias("band"), "q").groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.round(F.median("q"), 6).alias("median_q"), F.round(F.avg((F.col("q") > 100).cast("int")), 6).alias("large"))


@query("json_props", "select event_type, count(*) as n, sum(cast(json_extract_string(props, '$.k') as bigint))::bigint as k from events group by event_type")
def json_props(spark, sf_dir):
    """Sums over a number inside a JSON column."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k"))
