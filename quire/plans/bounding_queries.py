"""Bounding of descriptions and what it removed."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bounding, cleaning, keyness
from .corpus_queries import _NORM, _ROWS_SQL, matched_pairs, pair_tokens
from ..runtime import cut
from .registry import query
from .text_queries import BOOKS_SQL, records

_SPLIT = "list_filter(list_transform(string_split(regexp_replace(regexp_replace({c}, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda s: trim(s, ' ' || chr(9) || chr(13))), lambda s: s <> '')"


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _rules(rules) -> str:
    return "list_filter([" + ", ".join(f"case when regexp_matches(sentence, '(?i){_q(p)}') then '{n}' end" for n, p in rules) + "], lambda x: x is not null)"


def _hit(pattern: str, c: str = "sentence") -> str:
    return f"regexp_matches({c}, '{_q(pattern)}')"


_FLAGS_SQL = f"""bs as (select book_id, {_SPLIT.format(c='description')} as ss from records where description is not null),
br as (select book_id, unnest(range(0, len(ss)))::int as pos, unnest(ss) as sentence from bs),
bk as (select br.*, rep.key is not null as repeated from br left join rep on {_NORM.format(c='br.sentence')} = rep.key),
bf as (select *, {_rules(bounding.PREFACE_RULES)} as pre, list_concat({_rules(bounding.POSTSCRIPT_RULES)}, {_rules(bounding.HARD_POSTSCRIPT_RULES)}) as post,
  len({_rules(bounding.HARD_POSTSCRIPT_RULES)}) > 0 as hard,
  list_concat({_rules(bounding.FOOTER_RULES + bounding.JUNK_RULES)}, list_filter([case when repeated then 'repeated_across_books' end,
    case when {_hit(bounding.REVIEW_ATTRIBUTION)} or {_hit(bounding.REVIEW_SOURCE)} then 'review_attribution' end, case when {_hit(bounding.READER_ADDRESS)} then 'reader_address' end,
    case when {_hit(bounding.HEADING, "regexp_replace(trim(sentence), '\\s+', ' ', 'g')")} then 'heading_colon' end,
    case when {_hit(bounding.EDITION_SUBJECT)} and {_hit(bounding.EDITION_VERB)} and {_hit(bounding.EDITION_OBJECT)} then 'edition_statement' end], lambda x: x is not null)) as any_,
  list_filter([case when {_hit(bounding.PRODUCT_VOICE)} then 'product_voice' end, case when len(regexp_extract_all(sentence, '\\p{{L}}')) >= 20 and len(regexp_extract_all(sentence, '\\p{{Lu}}')) >= 0.8 * len(regexp_extract_all(sentence, '\\p{{L}}')) then 'all_caps' end], lambda x: x is not null) as weak from bk),
flags as (select book_id, pos, sentence, hard, list_concat(pre, post, any_, case when len(weak) > 0 and len(pre) + len(post) + len(any_) > 0 then weak else [] end) as rules,
  case when len(any_) > 0 or (len(weak) > 0 and len(pre) + len(post) + len(any_) > 0) or (len(pre) > 0 and len(post) > 0) then 'any' when len(pre) > 0 then 'preface' when len(post) > 0 then 'postscript' end as kind from bf)"""


def _repeated(spark, sf_dir):
    # written, so that its size is known and a small set is sent to the tasks
    return cut(cleaning.repeated_sentences(records(spark, sf_dir, "description"), "book_id", "description"))


def flags(spark, sf_dir):
    rows = records(spark, sf_dir, "description").select("book_id", F.posexplode(T.lines_and_sentences(F.col("description"))).alias("pos", "sentence"))
    keyed = rows.withColumn("_key", T.normalise(F.col("sentence"))).join(_repeated(spark, sf_dir).select(F.col("key").alias("_key"), F.lit(True).alias("repeated")), "_key", "left")
    return bounding.flag_rows(keyed, "sentence", "repeated")


@query("bound_flags", f"with {BOOKS_SQL}, {_ROWS_SQL}, {_FLAGS_SQL} select book_id, pos, kind, array_to_string(rules, ',') as rules from flags where len(rules) > 0")
def bound_flags(spark, sf_dir):
    """The sentences that any rule flags, with the rules and the kind."""
    return flags(spark, sf_dir).where(F.size("rules") > 0).select("book_id", "pos", "kind", F.array_join("rules", ",").alias("rules"))


_BOUND_SQL = f"""{_FLAGS_SQL},
n as (select book_id, count(*)::int as n from flags group by book_id),
lo as (select n.book_id, n, coalesce(min(pos) filter (where kind is null or kind = 'postscript'), any_value(n)) as lo from n join flags using (book_id) group by n.book_id, n),
hi0 as (select lo.book_id, n, lo, greatest(lo, coalesce(max(pos + 1) filter (where kind is null or kind = 'preface'), 0)) as hi from lo join flags using (book_id) group by lo.book_id, n, lo),
hi as (select hi0.book_id, n, lo, coalesce(min(pos) filter (where hard and pos >= 1 and pos < hi), any_value(hi)) as hi from hi0 join flags using (book_id) group by hi0.book_id, n, lo, hi),
kept as (select hi.book_id, n, lo, hi, coalesce(string_agg(sentence, ' ' order by pos) filter (where pos >= lo and pos < hi), '') as kept, string_agg(sentence, ' ' order by pos) as full_text,
  count(*) filter (where len(rules) > 0 and not (pos >= lo and pos < hi)) as n_removed,
  count(*) filter (where len(rules) > 0 and not (pos >= lo and pos < hi) and len(list_filter(rules, lambda r: r not in ({','.join(repr(r) for r in bounding.HARD_EVIDENCE)}))) > 0) as n_soft from hi join flags using (book_id) group by hi.book_id, n, lo, hi),
bounded as (select *, (length(kept) < 80 or length(kept) < 0.25 * length(full_text)) and not (n_removed > 0 and n_soft = 0) as fallback from kept)"""


@query("bound_texts", f"with {BOOKS_SQL}, {_ROWS_SQL}, {_BOUND_SQL} select book_id, lo::int as lo, hi::int as hi, n as n_sentences, fallback, case when fallback then full_text else kept end as bounded, n_removed::int as n_removed from bounded")
def bound_texts(spark, sf_dir):
    """Descriptions without the publisher text at their edges."""
    found = bounding.bound(records(spark, sf_dir, "description"), "book_id", "description", _repeated(spark, sf_dir))
    return found.select("book_id", "lo", "hi", "n_sentences", "fallback", "bounded", F.size("removed").alias("n_removed"))


@query("bound_rule_stats", f"with {BOOKS_SQL}, {_ROWS_SQL}, {_FLAGS_SQL}, r as (select book_id, length(sentence) as n, unnest(rules) as rule from flags) select rule, count(*) as n_fired, count(distinct book_id) as n_books, round(avg(n), 6) as mean_chars from r group by rule")
def bound_rule_stats(spark, sf_dir):
    """How often each rule fired."""
    rows = flags(spark, sf_dir).select("book_id", F.length("sentence").alias("n"), F.explode("rules").alias("rule"))
    return rows.groupBy("rule").agg(F.count(F.lit(1)).alias("n_fired"), F.countDistinct("book_id").alias("n_books"), F.round(F.avg("n"), 6).alias("mean_chars"))


@query("bound_trim_rate", f"with {BOOKS_SQL}, {_ROWS_SQL}, {_BOUND_SQL} select count(*) as n, round(avg((not fallback and n_removed > 0)::int), 6) as touched, round(avg(fallback::int), 6) as fallback_rate, round(1 - sum(case when fallback then length(full_text) else length(kept) end) / sum(length(full_text)), 6) as trimmed from bounded")
def bound_trim_rate(spark, sf_dir):
    """Share of texts touched, undone, and of characters trimmed."""
    full = records(spark, sf_dir, "description").select("book_id", F.length(F.array_join(T.lines_and_sentences(F.col("description")), " ")).alias("full_n"))
    found = bounding.bound(records(spark, sf_dir, "description"), "book_id", "description", _repeated(spark, sf_dir)).join(full, "book_id")
    return found.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((~F.col("fallback") & (F.size("removed") > 0)).cast("int")), 6).alias("touched"), F.round(F.avg(F.col("fallback").cast("int")), 6).alias("fallback_rate"),
        F.round(1 - F.sum(F.length("bounded")) / F.sum("full_n"), 6).alias("trimmed"),
    )


@query("publication_names", f"with {BOOKS_SQL} select book_id, trim(regexp_replace(regexp_replace(description, '(?i)#?\\s*1?\\s*new york times|usa today|\\bgoodreads\\b', ' ', 'g'), '\\s{{2,}}', ' ', 'g')) as text from records where regexp_matches(description, '(?i)new york times|usa today|\\bgoodreads\\b')")
def publication_names(spark, sf_dir):
    """Texts that name newspapers, without the names."""
    found = records(spark, sf_dir, "description").where(F.col("description").rlike(r"(?i)new york times|usa today|\bgoodreads\b"))
    return found.select("book_id", bounding.strip_publications(F.col("description")).alias("text"))


def register_dict(spark, sf_dir):
    """The register weights by word; words of enough occurrences are few."""
    return {r["word"]: r["weight"] for r in keyness.register_weights(pair_tokens(spark, sf_dir)).collect()}


def register_map(spark, sf_dir):
    """The register weights as one map, a constant of the plan."""
    return F.from_json(F.lit(json.dumps(register_dict(spark, sf_dir))), "map<string,double>")


@query("plot_overlap")
def plot_overlap(spark, sf_dir):
    """Jaccard overlap with the summary before and after bounding, for the matched pairs."""
    pairs = matched_pairs(spark, sf_dir)
    after = bounding.bound(pairs, "wiki_id", "description", _repeated(spark, sf_dir), register_map(spark, sf_dir)).select("wiki_id", "bounded", "fallback")
    jaccard = lambda a, b: F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
    s, d, b = (T.content_words(F.col(c)) for c in ("summary", "description", "bounded"))
    return pairs.join(after, "wiki_id").select("wiki_id", F.round(jaccard(d, s), 6).alias("before"), F.round(jaccard(b, s), 6).alias("after"), "fallback")
