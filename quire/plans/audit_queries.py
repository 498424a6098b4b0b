"""What bounding costs and takes away, by decade, weight and rule; bands of editions; p-values."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bounding
from ..operators import stats as S
from ..runtime import table
from . import registry
from .bounding_queries import _BOUND_SQL, _repeated, register_dict
from .corpus_queries import _PAIRS_SQL, _ROWS_SQL, matched_pairs, register_weights
from .registry import query
from .text_queries import _STAT_NAMES, _STOP, BOOKS_SQL, SUMMARIES_SQL, records, summary_stats

_FIRST_YEARS = "y as (select work_id, max(cast(nullif(regexp_extract(original_publication_year, '\\b(1[5-9]\\d{2}|20\\d{2})\\b', 1), '') as int)) as year from goodreads_book_works group by work_id)"


@query("bound_trim_by_decade", f"""with {BOOKS_SQL}, {_ROWS_SQL}, {_BOUND_SQL}, {_FIRST_YEARS}, d as (select bounded.*, cast(floor(year / 10) * 10 as int) as decade from bounded join records using (book_id) join y using (work_id) where year <= 2017)
select decade, count(*) as n, round(avg((not fallback and n_removed > 0)::int), 6) as touched, round(avg(fallback::int), 6) as fallback_rate,
  round(1 - sum(case when fallback then length(full_text) else length(kept) end) / sum(length(full_text)), 6) as trimmed from d group by decade""")
def bound_trim_by_decade(spark, sf_dir):
    """Share of texts touched, undone, and of characters trimmed in each decade."""
    rows = records(spark, sf_dir, "work_id", "description")
    years = table(spark, sf_dir, "goodreads_book_works").select("work_id", T.year_in(F.col("original_publication_year"), 2099).alias("y")).groupBy("work_id").agg(F.max("y").alias("year")).where("year <= 2017")
    full = rows.select("book_id", "work_id", F.length(F.array_join(T.lines_and_sentences(F.col("description")), " ")).alias("full_n"))
    dated = full.join(years, "work_id").select("book_id", "full_n", T.decade("year").alias("decade"))
    found = bounding.bound(rows, "book_id", "description", _repeated(spark, sf_dir)).join(dated, "book_id")
    touched = ~F.col("fallback") & (F.size("removed") > 0)
    return found.groupBy("decade").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(touched.cast("int")), 6).alias("touched"), F.round(F.avg(F.col("fallback").cast("int")), 6).alias("fallback_rate"),
        F.round(1 - F.sum(F.length("bounded")) / F.sum("full_n"), 6).alias("trimmed"),
    )


_STRICT_SQL = _BOUND_SQL.replace(" and len(pre) + len(post) + len(any_) > 0", "").replace(
    "string_agg(sentence, ' ' order by pos) filter (where pos >= lo and pos < hi)", "string_agg(sentence, ' ' order by pos) filter (where pos >= lo and pos < hi and kind is distinct from 'any')"
).replace("not (pos >= lo and pos < hi)", "not (pos >= lo and pos < hi and kind is distinct from 'any')")


@query("bound_strict", f"with {BOOKS_SQL}, {_ROWS_SQL}, {_STRICT_SQL} select book_id, fallback, n_removed::int as n_removed, length(case when fallback then full_text else kept end) as n_chars from bounded")
def bound_strict(spark, sf_dir):
    """Bounding that also drops flagged sentences inside the text."""
    found = bounding.bound(records(spark, sf_dir, "description"), "book_id", "description", _repeated(spark, sf_dir), strict=True)
    return found.select("book_id", "fallback", F.size("removed").alias("n_removed"), F.length("bounded").cast("bigint").alias("n_chars"))


_CONTENT = "list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z][a-z'']+'), lambda w: length(w) > 2 and w not in ({s})))"
_SPANS_SQL = f"""{BOOKS_SQL}, {_ROWS_SQL}, {_PAIRS_SQL}, {_BOUND_SQL.replace('from records where', 'from (select wiki_id as book_id, description from pairs) where')},
spans as (select hi.book_id as wiki_id, pos, array_to_string(rules, ',') as rules, sentence from hi join flags using (book_id) where len(rules) > 0 and not (pos >= lo and pos < hi)),
audit as (select wiki_id, pos, rules, length(sentence) as n_chars, len(sw) as n_words, len(list_intersect(sw, pw)) / nullif(len(sw), 0)::double as overlap from
  (select spans.*, {_CONTENT.format(c='sentence', s=_STOP)} as sw, {_CONTENT.format(c='summary', s=_STOP)} as pw from spans join pairs using (wiki_id))),
judged as (select *, coalesce(n_words >= 4 and overlap >= 0.5, false) as suspicious from audit)"""


def _audit(spark, sf_dir):
    """Removed sentences of the matched pairs, with the share of their words that the plot has too."""
    pairs = matched_pairs(spark, sf_dir)
    found = bounding.bound(pairs.select("wiki_id", "description"), "wiki_id", "description", _repeated(spark, sf_dir))
    spans = found.select("wiki_id", F.explode("removed").alias("r")).select("wiki_id", "r.*").join(pairs.select("wiki_id", "summary"), "wiki_id")
    words, plot = T.content_words(F.col("sentence")), T.content_words(F.col("summary"))
    n = F.size(words)
    rows = spans.select("wiki_id", "pos", "rules", F.length("sentence").cast("bigint").alias("n_chars"), n.cast("bigint").alias("n_words"), (F.size(F.array_intersect(words, plot)) / F.nullif(n, F.lit(0))).alias("overlap"))
    return rows.withColumn("suspicious", F.coalesce((F.col("n_words") >= 4) & (F.col("overlap") >= 0.5), F.lit(False)))


@query("removal_audit", f"with {SUMMARIES_SQL}, {_SPANS_SQL} select wiki_id, pos, rules, n_words, round(overlap, 6) as overlap, suspicious from judged")
def removal_audit(spark, sf_dir):
    """Every removed sentence with the share of its words that the summary has; half or more is suspicious."""
    return _audit(spark, sf_dir).select("wiki_id", "pos", "rules", "n_words", F.round("overlap", 6).alias("overlap"), "suspicious")


@query("audit_rules", f"with {SUMMARIES_SQL}, {_SPANS_SQL} select rules, count(*) as n, count(*) filter (where suspicious) as suspicious from judged group by rules order by suspicious desc, n desc, rules limit 12")
def audit_rules(spark, sf_dir):
    """The rules behind suspicious removals, the most frequent first."""
    return _audit(spark, sf_dir).groupBy("rules").agg(F.count(F.lit(1)).alias("n"), F.count_if("suspicious").alias("suspicious")).orderBy(F.desc("suspicious"), F.desc("n"), "rules").limit(12)


@query("largest_removals", f"with {SUMMARIES_SQL}, {_SPANS_SQL} select wiki_id, pos, n_chars, round(overlap, 6) as overlap from judged order by judged.overlap desc nulls last, n_chars desc, wiki_id, pos limit 25")
def largest_removals(spark, sf_dir):
    """The twenty-five removed sentences that share most with the plot."""
    rows = _audit(spark, sf_dir).orderBy(F.desc_nulls_last("overlap"), F.desc("n_chars"), "wiki_id", "pos").limit(25)
    return rows.select("wiki_id", "pos", "n_chars", F.round("overlap", 6).alias("overlap"))


@query("register_dense_flags")
def register_dense_flags(spark, sf_dir):
    """Sentences that only the register weights flag, with the score of their words."""
    rows = records(spark, sf_dir, "description").select("book_id", F.posexplode(T.lines_and_sentences(F.col("description"))).alias("pos", "sentence"))
    return bounding.dense_rows(rows, "sentence", register_dict(spark, sf_dir)).select("book_id", "pos", F.round("mean", 6).alias("mean"), "n")


_COST_SQL = f"""wts as ({registry._SQL['register_weights']}), t as (select unnest(regexp_extract_all(lower(description), '[a-z][a-z'']+')) as word from records where description is not null),
c as (select word, count(*) as n from t group by word), j as (select c.word, n, weight from c left join wts on c.word = wts.word),
r as (select word, weight, sum(n) over (order by weight desc, word) / (select sum(n) from c)::double as share from j where weight > 0)"""


def _cost(spark, sf_dir):
    weights = register_weights(spark, sf_dir).where("weight > 0").select("word", "weight")
    t = records(spark, sf_dir, "description").where("description is not null").select(F.explode(F.regexp_extract_all(F.lower("description"), F.lit("([a-z][a-z']+)"), F.lit(1))).alias("word"))
    c = t.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    # the words that have a weight are few: those of enough occurrences in the matched pairs
    running = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("weight"), "word"))
    return c.join(weights, "word").crossJoin(F.broadcast(total)).select("word", "weight", (running / F.col("total")).alias("share"))


@query("removed_by_weight", f"with {BOOKS_SQL}, {_COST_SQL} select word, weight, round(share, 6) as share from r")
def removed_by_weight(spark, sf_dir):
    """Share of all words that is gone once the words of at least this register weight are removed."""
    return _cost(spark, sf_dir).withColumn("share", F.round("share", 6))


def _band(c: str) -> str:
    return f"case when {c} = 1 then '1' when {c} < 5 then '2-4' when {c} < 10 then '5-9' when {c} < 25 then '10-24' when {c} < 50 then '25-49' else '50+' end"


@query("edition_bands", f"""with {BOOKS_SQL}, s as (select work_id, count(*) as n, median(length(description)) as chars, avg((language_code is not null)::int) as labelled from records where work_id is not null group by work_id)
select {_band('n')} as band, count(*) as works, sum(n)::bigint as editions, round(median(chars), 6) as median_chars, round(avg((labelled >= 0.5)::int), 6) as mostly_labelled from s group by band""")
def edition_bands(spark, sf_dir):
    """Works in bands of their number of editions, with medians."""
    s = records(spark, sf_dir, "work_id", "description", "language_code").where("work_id is not null").groupBy("work_id").agg(
        F.count(F.lit(1)).alias("n"), F.median(F.length("description")).alias("chars"), F.avg(F.col("language_code").isNotNull().cast("int")).alias("labelled")
    )
    return s.groupBy(F.expr(_band("n")).alias("band")).agg(
        F.count(F.lit(1)).alias("works"), F.sum("n").alias("editions"), F.round(F.median("chars"), 6).alias("median_chars"), F.round(F.avg((F.col("labelled") >= 0.5).cast("int")), 6).alias("mostly_labelled")
    )


@query("correlation_p_values")
def correlation_p_values(spark, sf_dir):
    """Correlations of the statistics with the year and their two-sided p-values, the strongest first."""
    found = S.correlations(summary_stats(spark, sf_dir), "year", _STAT_NAMES)

    @F.pandas_udf("double")
    def p_value(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([S.t_p_value(float(a), int(b)) for a, b in zip(r, n)])

    rated = found.withColumn("pearson_p", p_value("pearson", "n")).withColumn("spearman_p", p_value("spearman", "n"))
    return rated.orderBy(F.desc(F.abs("pearson")), "feature")
