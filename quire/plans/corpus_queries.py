"""Cleaning, keyness and word weighting over descriptions and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text as T
from ..operators import cleaning, keyness
from .registry import query
from .text_queries import _STOP, BOOKS_SQL, SUMMARIES_SQL, _W, records, summaries

_NORM = "trim(regexp_replace(trim(lower({c})), '\\s+', ' ', 'g'))"
_SENT = "list_filter(list_transform(string_split(regexp_replace(trim({c}), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"

_ROWS_SQL = f"""docs as (select book_id, description from records where description is not null),
split as (select book_id, {_SENT.format(c='description')} as ss from docs),
rows as (select book_id, unnest(range(1, len(ss) + 1)) as pos, unnest(ss) as sentence from split),
keyed as (select *, {_NORM.format(c='sentence')} as key from rows),
rep as (select key, count(distinct book_id) as n_docs from keyed where length(key) >= 25 group by key having count(distinct book_id) >= 10)"""


@query("repeated_sentences", f"with {BOOKS_SQL}, {_ROWS_SQL} select * from rep")
def repeated_sentences(spark, sf_dir):
    """Sentences that stand in at least ten descriptions."""
    return cleaning.repeated_sentences(records(spark, sf_dir, "description"), "book_id", "description")


@query("strip_repeated", f"with {BOOKS_SQL}, {_ROWS_SQL} select book_id, coalesce(string_agg(sentence, ' ' order by pos) filter (where n_docs is null), '') as text, coalesce(sum(length(sentence)) filter (where n_docs is not null), 0)::bigint as stripped_chars from keyed left join rep using (key) group by book_id")
def strip_repeated(spark, sf_dir):
    """Descriptions without the sentences repeated across descriptions."""
    return cleaning.strip_repeated(records(spark, sf_dir, "description"), "book_id", "description")


_BP = "|".join(cleaning.BOILERPLATE)
_CLEAN_SQL = f"""base as (select book_id, description as text from records where description is not null and not regexp_matches(description, '(?i){_BP}')),
exact as (select book_id, text from (select *, row_number() over (partition by md5({_NORM.format(c='text')}) order by book_id) as k from base) where k = 1),
near as (select book_id, text from (select *, row_number() over (partition by substring({_NORM.format(c='text')}, 1, 120) order by book_id) as k from exact) where k = 1),
nsplit as (select book_id, {_SENT.format(c='text')} as ss from near),
nrows as (select book_id, unnest(range(1, len(ss) + 1)) as pos, unnest(ss) as sentence from nsplit),
nkeyed as (select *, {_NORM.format(c='sentence')} as key from nrows),
nrep as (select key, count(distinct book_id) as n_docs from nkeyed where length(key) >= 25 group by key having count(distinct book_id) >= 10),
cleaned as (select book_id, coalesce(string_agg(sentence, ' ' order by pos) filter (where n_docs is null), '') as text, coalesce(sum(length(sentence)) filter (where n_docs is not null), 0)::bigint as stripped_chars from nkeyed left join nrep using (key) group by book_id)"""


@query("clean_corpus", f"with {BOOKS_SQL}, {_CLEAN_SQL} select * from cleaned where length(text) >= 200")
def clean_corpus(spark, sf_dir):
    """Descriptions after all cleaning steps."""
    return cleaning.clean_corpus(records(spark, sf_dir, "description"), "book_id", "description")


@query("near_dup_first", f"with {BOOKS_SQL}, {_CLEAN_SQL} select book_id from near")
def near_dup_first(spark, sf_dir):
    """The first record of each exact and each prefix duplicate group."""
    base = records(spark, sf_dir, "description").where("description is not null").where(~cleaning.is_boilerplate(F.col("description")))
    exact = cleaning.keep_first(base, F.md5(T.normalise(F.col("description"))), ["book_id"])
    return cleaning.keep_first(exact, F.substring(T.normalise(F.col("description")), 1, 120), ["book_id"]).select("book_id")


_DECADES = "y as (select work_id, cast(floor(max(cast(nullif(regexp_extract(original_publication_year, '\\b(1[5-9]\\d{2}|20\\d{2})\\b', 1), '') as int)) / 10) * 10 as int) as decade from goodreads_book_works group by work_id)"


def _decades(spark, sf_dir):
    from ..runtime import table

    return table(spark, sf_dir, "goodreads_book_works").select("work_id", T.year_in(F.col("original_publication_year"), 2099).alias("y")).groupBy("work_id").agg(T.decade(F.max("y")).alias("decade"))


@query("clean_stats", f"with {BOOKS_SQL}, {_CLEAN_SQL}, {_DECADES}, b as (select decade, count(*) as n_before from records r join y using (work_id) where description is not null and decade is not null group by decade), a as (select decade, count(*) as n_after, sum(stripped_chars)::bigint as stripped, sum(length(text))::bigint as kept from (select * from cleaned where length(text) >= 200) c join records r using (book_id) join y using (work_id) where decade is not null group by decade) select decade, n_before, coalesce(n_after, 0) as n_after, coalesce(stripped, 0) as chars_stripped, round(100.0 * (n_before - coalesce(n_after, 0)) / n_before, 6) as pct_docs_dropped from b left join a using (decade)")
def clean_stats(spark, sf_dir):
    """What cleaning removed, by decade."""
    base = records(spark, sf_dir, "work_id", "description").where("description is not null").join(_decades(spark, sf_dir).where("decade is not null"), "work_id")
    before = base.groupBy("decade").agg(F.count(F.lit(1)).alias("n_before"))
    kept = clean_corpus(spark, sf_dir).join(base.select("book_id", "decade"), "book_id")
    after = kept.groupBy("decade").agg(F.count(F.lit(1)).alias("n_after"), F.sum("stripped_chars").alias("stripped"))
    zero = F.lit(0).cast("bigint")
    return before.join(after, "decade", "left").select("decade", "n_before", F.coalesce("n_after", zero).alias("n_after"), F.coalesce("stripped", zero).alias("chars_stripped"), F.round(100.0 * (F.col("n_before") - F.coalesce("n_after", zero)) / F.col("n_before"), 6).alias("pct_docs_dropped"))


# Two registers of the same item: the summary and a description under the same title key.
_FOLDED = "lower(strip_accents({c}))"
_KEY = "trim(regexp_replace(regexp_replace(lower(strip_accents({c})), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g'))"
_PAIRS_SQL = f"""s as (select *, {_KEY.format(c='title')} as k from books where length(trim(summary)) > 50),
su as (select * from s where length(k) >= 6 and k in (select k from s group by k having count(*) = 1)),
g as (select r.work_id, {_KEY.format(c='title_without_series')} as k, description, w.year from records r join (select work_id, max(cast(nullif(regexp_extract(original_publication_year, '\\b(1[5-9]\\d{{2}}|20\\d{{2}})\\b', 1), '') as int)) as year from goodreads_book_works group by work_id) w using (work_id) where length(description) >= 80),
gw as (select work_id, k, min(description) as description, max(year) as year from g group by work_id, k),
c as (select su.k, wiki_id, decade, summary, description, work_id, abs(su.year - gw.year) as gap, count(*) over (partition by su.k) as n, sum(case when abs(su.year - gw.year) <= 2 then 1 else 0 end) over (partition by su.k) as near from su join gw using (k)),
pairs as (select k, wiki_id, decade, summary, description, work_id from c where (n = 1 and (gap is null or gap <= 2)) or (n > 1 and near = 1 and gap <= 2))"""


def matched_pairs(spark, sf_dir):
    """Summaries and descriptions of one title: unique titles, years within two of each other.

    With several candidates exactly one must be near; a single one may lack a year.
    """
    from ..runtime import table

    s = summaries(spark, sf_dir).where("length(trim(summary)) > 50").withColumn("k", T.title_key(F.col("title"))).where("length(k) >= 6")
    once = s.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("k")
    years = table(spark, sf_dir, "goodreads_book_works").select("work_id", T.year_in(F.col("original_publication_year"), 2099).alias("y")).groupBy("work_id").agg(F.max("y").alias("gy"))
    g = records(spark, sf_dir, "work_id", "title_without_series", "description").where("length(description) >= 80").join(years, "work_id").withColumn("k", T.title_key(F.col("title_without_series")))
    g = g.groupBy("work_id", "k").agg(F.min("description").alias("description"), F.max("gy").alias("gy"))
    c = s.join(once, "k").join(g, "k").withColumn("gap", F.abs(F.col("year") - F.col("gy")))
    near = F.coalesce(F.col("gap") <= 2, F.lit(False))
    counts = c.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_if(near).alias("near"))
    kept = c.join(counts, "k").where(((F.col("n") == 1) & (F.col("gap").isNull() | near)) | ((F.col("n") > 1) & (F.col("near") == 1) & near))
    return kept.select("k", "wiki_id", "decade", "summary", "description", "work_id")


@query("year_tolerance_join", f"with {SUMMARIES_SQL}, {BOOKS_SQL}, {_PAIRS_SQL} select k, wiki_id, work_id, decade from pairs")
def year_tolerance_join(spark, sf_dir):
    """Unique titles of both sources whose years are within two of each other."""
    return matched_pairs(spark, sf_dir).select("k", "wiki_id", "work_id", "decade")


_TOKENS_SQL = f"""words as (select wiki_id as doc, decade as period, 'a' as side, unnest(list_filter(regexp_extract_all(lower(description), '[a-z]+'), lambda w: length(w) > 2 and w not in ({_STOP}))) as word from pairs
  union all select wiki_id, decade, 'b', unnest(list_filter(regexp_extract_all(lower(summary), '[a-z]+'), lambda w: length(w) > 2 and w not in ({_STOP}))) from pairs),
tot as (select sum((side = 'a')::int)::double as ta, sum((side = 'b')::int)::double as tb, count(distinct case when side = 'a' then doc end) as da, count(distinct case when side = 'b' then doc end) as db, count(distinct doc) as nd from words),
cnt as (select word, sum((side = 'a')::int)::double as a, sum((side = 'b')::int)::double as b, count(distinct case when side = 'a' then doc end) as ka, count(distinct case when side = 'b' then doc end) as kb from words group by word having count(*) >= 20),
kn as (select word, a::bigint as tokens_a, b::bigint as tokens_b, 2 * ((case when a > 0 then a * ln(a / (ta * (a + b) / (ta + tb))) else 0 end) + (case when b > 0 then b * ln(b / (tb * (a + b) / (ta + tb))) else 0 end)) as g2,
  log2(((a + 0.5) / ta) / ((b + 0.5) / tb)) as log_ratio, a / ta * 1e4 as per_10k_a, b / tb * 1e4 as per_10k_b, ka / da::double as doc_share_a, kb / db::double as doc_share_b from cnt, tot),
pres as (select word, doc, max((side = 'a')::int) as a, max((side = 'b')::int) as b from words group by word, doc),
p4 as (select word, sum(a * b)::double as both_sides, sum(a)::double as na, sum(b)::double as nb, any_value(nd)::double as n from pres, tot group by word),
ph as (select word, coalesce((both_sides * n - na * nb) / nullif(sqrt(na * nb * (n - na) * (n - nb)), 0), 0) as phi, both_sides::bigint as both_n, (na - both_sides)::bigint as a_only, (nb - both_sides)::bigint as b_only from p4),
pt as (select period, sum((side = 'a')::int)::double as ta, sum((side = 'b')::int)::double as tb from words group by period having count(distinct doc) >= 5),
pw as (select word, period, sum((side = 'a')::int) as a, sum((side = 'b')::int) as b from words group by word, period),
cons as (select word, avg((a / ta > b / tb)::int) as consistency from pw join pt using (period) group by word)"""


def pair_tokens(spark, sf_dir):
    """Words of both sides of the matched pairs: ``doc, period, side, word``."""
    pairs = matched_pairs(spark, sf_dir)
    found = lambda c: F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), F.lit(1)), lambda w: (F.length(w) > 2) & ~w.isin(*T.STOP_WORDS))
    sides = F.array(F.struct(F.lit("a").alias("side"), found("description").alias("ws")), F.struct(F.lit("b").alias("side"), found("summary").alias("ws")))
    each = pairs.select(F.col("wiki_id").alias("doc"), F.col("decade").alias("period"), F.explode(sides).alias("x"))
    return each.select("doc", "period", "x.side", F.explode("x.ws").alias("word"))


def _keyed(extra: str) -> str:
    return f"with {SUMMARIES_SQL}, {BOOKS_SQL}, {_PAIRS_SQL}, {_TOKENS_SQL} {extra}"


_ROUND = ["g2", "log_ratio", "per_10k_a", "per_10k_b", "doc_share_a", "doc_share_b"]


@query("keyness_g2", _keyed("select word, tokens_a, tokens_b, " + ", ".join(f"round({c}, 6) as {c}" for c in _ROUND) + " from kn"))
def keyness_g2(spark, sf_dir):
    """Keyness of the words of descriptions against summaries."""
    return keyness.keyness(pair_tokens(spark, sf_dir)).select("word", "tokens_a", "tokens_b", *[F.round(c, 6).alias(c) for c in _ROUND])


@query("keyness_consistency", _keyed("select word, round(consistency, 6) as consistency from cons"))
def keyness_consistency(spark, sf_dir):
    """Share of the decades in which a word is more frequent in descriptions."""
    return keyness.consistency(pair_tokens(spark, sf_dir).where("period is not null"), 5).select("word", F.round("consistency", 6).alias("consistency"))


@query("phi_association", _keyed("select word, round(phi, 6) as phi, case when phi < 0.05 then 'register' when phi < 0.12 then 'borderline' else 'content' end as tier, both_n, a_only, b_only from ph"))
def phi_association(spark, sf_dir):
    """Association of a word's presence on both sides of the pairs, with its tier."""
    found = keyness.phi_association(pair_tokens(spark, sf_dir))
    return found.select("word", F.round("phi", 6).alias("phi"), keyness.phi_tier(F.col("phi")).alias("tier"), F.col("both").alias("both_n"), "a_only", "b_only")


_WEIGHTS_SQL = "wt as (select word, case when log_ratio > 0 then log_ratio * greatest(0, 1 - greatest(phi, 0) / 0.12) else log_ratio end as weight, phi, log_ratio, g2 from kn join ph using (word) where g2 >= 15.13)"


@query("register_weights", _keyed(f", {_WEIGHTS_SQL} select word, round(weight, 6) as weight, round(g2, 6) as g2 from wt where weight <> 0"))
def register_weights(spark, sf_dir):
    """Register weights of words."""
    return keyness.register_weights(pair_tokens(spark, sf_dir)).select("word", F.round("weight", 6).alias("weight"), F.round("g2", 6).alias("g2"))


@query("keyness_removal", _keyed("select word from kn join cons using (word) where tokens_a > 0 and log_ratio >= 0.585 and g2 >= 15.13 and doc_share_a >= 0.005 and consistency >= 0.85"))
def keyness_removal(spark, sf_dir):
    """Words that meet every condition of the removal list."""
    tokens = pair_tokens(spark, sf_dir)
    joined = keyness.keyness(tokens).join(keyness.consistency(tokens.where("period is not null"), 5), "word")
    return joined.where((F.col("log_ratio") >= keyness.MIN_LOG_RATIO) & (F.col("g2") >= keyness.MIN_G2) & (F.col("doc_share_a") >= keyness.MIN_DOC_SHARE) & (F.col("consistency") >= keyness.MIN_CONSISTENCY)).select("word")


# TF-IDF in long form, a decade of summaries as one document and the top words of each.
_TFIDF_SQL = f"""t as (select decade, unnest(list_filter(regexp_extract_all(lower(summary), '[a-z]+'), lambda w: length(w) > 2 and w not in ({_STOP}))) as word from books where decade is not null),
tf as (select decade, word, 1 + ln(count(*)) as tf from t group by decade, word),
idf as (select word, ln((1 + (select count(distinct decade) from t)) / (1.0 + count(*))) + 1 as idf from tf group by word),
v as (select decade, word, tf * idf as w from tf join idf using (word)),
nv as (select decade, word, w / sqrt(sum(w * w) over (partition by decade)) as w from v)"""


def tfidf(rows, doc: str, term: str):
    """``doc, term, weight``: sublinear TF-IDF with smoothed IDF, vectors of length one."""
    tf = rows.groupBy(doc, term).agg((1 + F.ln(F.count(F.lit(1)))).alias("tf"))
    n = rows.select(doc).distinct().agg(F.count(F.lit(1)).alias("n_docs"))
    df = tf.groupBy(term).agg(F.count(F.lit(1)).alias("df"))
    idf = df.crossJoin(F.broadcast(n)).select(term, (F.ln((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    v = tf.join(idf, term).select(doc, term, (F.col("tf") * F.col("idf")).alias("w"))
    norm = v.groupBy(doc).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return v.join(norm, doc).select(doc, term, (F.col("w") / F.col("norm")).alias("weight"))


@query("tfidf_top_words", f"with {SUMMARIES_SQL}, {_TFIDF_SQL} select decade, word, round(w, 6) as weight from (select *, row_number() over (partition by decade order by round(w, 9) desc, word) as k from nv) where k <= 15")
def tfidf_top_words(spark, sf_dir):
    """The fifteen heaviest words of each decade."""
    rows = summaries(spark, sf_dir).where("decade is not null").select("decade", F.explode(F.filter(F.regexp_extract_all(F.lower("summary"), F.lit("([a-z]+)"), F.lit(1)), lambda w: (F.length(w) > 2) & ~w.isin(*T.STOP_WORDS))).alias("word"))
    order = Window.partitionBy("decade").orderBy(F.round("weight", 9).desc(), "word")
    return tfidf(rows, "decade", "word").withColumn("k", F.row_number().over(order)).where("k <= 15").select("decade", "word", F.round("weight", 6).alias("weight"))
