"""Trimming of publisher text at the edges of descriptions."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_all_caps, lines_and_sentences, normalise

# The rule lists, as name and pattern, in the order in which they are reported.
PREFACE_RULES = [
    ("bestselling_author", r"\b(#\s*1\s+)?(new york times|usa today|sunday times|wall street journal|internationally|nationally|globally)?\s*best[\s-]?selling author\b"),
    ("award_winner", r"^\s*\W*(winner of|shortlisted for|longlisted for|finalist for|nominated for|winner:)\b"),
    ("from_the_author_of", r"^\s*\W*from the (#\s*1\s+)?(new york times\s+)?(best[\s-]?selling\s+)?(author|creator|writer) of\b"),
    ("now_a_film", r"\bnow a (major )?(motion picture|film|netflix (series|original|film)|hbo (series|film)|major (television|tv) (series|event))\b|\bsoon to be a (major )?(motion picture|film|series)\b"),
    ("notable_book", r"^\s*\W*(an? )?(new york times )?(notable book|book of the year|best book of|editors'? choice|oprah'?s book club)\b"),
    ("instant_bestseller", r"^\s*\W*(the )?(instant )?(#\s*1\s+)?(new york times |usa today )?best[\s-]?seller\b"),
]
HARD_POSTSCRIPT_RULES = [
    ("about_the_author", r"^\s*\W*about the (author|translator|illustrator|editor|book)\b"),
    ("includes_extra", r"\bincludes? (a |an )?(excerpt|preview|bonus|sneak peek|reading group guide|discussion guide|readers guide)\b"),
    ("reading_guide", r"\b(reading (group|club) guide|discussion questions|questions for discussion|a readers guide)\b"),
    ("dont_miss", r"^\s*\W*(don'?t miss|look for|also by|also available|perfect for fans of|if you (loved|liked|enjoyed))\b"),
    ("praise_block", r"^\s*\W*praise for\b"),
]
POSTSCRIPT_RULES = [
    ("with_introduction", r"\bwith an? (new |brand[\s-]new )?(introduction|foreword|afterword|preface|essay) by\b"),
    ("translated_by", r"\btranslated (from the \w+ )?by\b|^\s*\W*edited by\b"),
    ("edition_stmt", r"^\s*\W*(this|the) (revised |deluxe |anniversary |special |new |expanded |updated )*(edition|printing|reissue|impression)\b"),
    ("first_published", r"^.{0,110}\b(first|originally) published (in|by)\b.{0,60}$"),
    ("cover_art", r"\bcover (art|design|illustration|photograph) by\b|\bjacket (design|art) by\b"),
    ("page_count", r"^\s*\W*\d{2,4} pages\b|\b\d{2,4} pages\.\s*$"),
]
JUNK_RULES = [
    ("award_badge", r"\b(ala|hugo|nebula|pulitzer|booker|newbery|caldecott|edgar|whitbread|costa|orange|nobel|national book|man booker|pen/faulkner)\b[^.!?]{0,40}\b(award|prize|winner|honou?r|best books?|notable)\b|^\W*an? [A-Z][^.!?]{0,50}\bbest books? for young adults\b|^[^.!?]{0,60}\bbest[\s-]?seller\b\s*[.!]?\s*$"),
    ("reprint_stmt", r"\b(unabridged|abridged|facsimile)\b[^.!?]{0,80}\b(republication|reprint|reproduction|edition|republished)\b|\b(republication|reprint) of the\b|\b(reissued|republished|reprinted) (by|in|as)\b|\bnow available in (paperback|hardcover|hardback|ebook|print)\b|\bavailable in (paperback|hardcover|ebook)[^.!?]{0,30}for the first time\b|\bmass market edition\b|\bdigitally (enlarged|reproduced|remastered)\b|\bupdated (typeface|layout)\b"),
    ("quote_attribution", "[\"'“”‘’][^\"'“”‘’]{3,}[\"'“”‘’]\\s*\\([^)]{3,40}\\)\\s*$|[\"'“”‘’][^\"'“”‘’]{6,}[\"'“”‘’]\\s+[A-Z][\\w' ]{2,30}\\s*$|^\\W*from \\d+ stars? reviews?\\b"),
    ("commerce", r"\bfree to download\b|\bplus excerpts? from\b|\bbonus (material|content)\b|\border (your copy|now)\b|\bon sale now\b|\bbuy (it |the )?now\b"),
    ("award_fragment", r"^\W*winner\s*[,:]\s*\w|^[^.!?]{0,60}\baward\b\s*[,:][^.!?]{0,80}\d{4}\s*[.!]?\s*$|^\W*(one of |an? )?[A-Z][\w' ]{2,30}('s)?\s*best\b[^.!?]{0,50}\b(books?|novels?|of \d{4})\b"),
    ("back_in_print", r"\bback in print\b|\bis (proud|pleased|delighted) to (reissue|present|publish|offer)\b|\b[A-Z][\w]* (Press|Books|Publishing|House) reissue of\b|\bnow in (paperback|hardcover|hardback)\b|\bhas been reissued\b"),
    ("ebook_format", r"\bcarefully crafted ebook\b|\bformatted for your (ereader|kindle|nook)\b|\bfunctional table of contents\b|\bactive table of contents\b|\bconverted from its physical edition\b"),
    ("author_positioning", r"\bis (widely |generally |universally )?(known|regarded|recognized|considered|celebrated|acclaimed|hailed)\s+(for|as)\b[^.!?]{0,80}\b(writer|author|novelist|poet|work|writing|fiction|literature|novels?|books?|stories|storytelling|prose)\b|\bhas established (himself|herself|themselves) as\b|\bone of the (foremost|greatest|finest|leading|most \w+) (writers?|authors?|novelists?|poets?|storytellers?|authorities)\b"),
    ("publication_history", r"\bbecame an? (immediate |instant |international )?best[\s-]?seller\b|\bwas adapted into (a )?(film|movie|television|tv)\b|\bwas selected by\b[^.!?]{0,60}\bfor\b[^.!?]{0,40}\b(annual|year'?s best)\b|\bwent on to (sell|become)\b"),
    ("front_matter_list", r"^\W*(foreword|preface|introduction|contents|translator'?s note)\b[^.!?]{0,80};"),
]
FOOTER_RULES = [
    ("copyright", r"copyright\s*(©|\(c\))|©\s*\d{4}|\ball rights reserved\b"),
    ("printed_in", r"\bprinted (and bound )?in (the )?[A-Z]"),
    ("isbn", r"\bisbn\b"),
    ("library_of_congress", r"\blibrary of congress\b"),
    ("fiction_disclaimer", r"\bis a work of fiction\b|\bany resemblance to (actual|real) (persons|events)\b"),
    ("url", r"www\.\S+|https?://\S+"),
    ("social", r"\b(visit|follow|find) (the author|us|him|her|them)?\s*.{0,40}(at |on )(twitter|instagram|facebook|www\.|http)"),
]
#: Patterns that are case-sensitive or used together.
REVIEW_ATTRIBUTION = "[\"“”]\\s*[-–—]{1,2}\\s*[A-Z][\\w.'’&\\- ]{2,40}\\s*$"
REVIEW_SOURCE = r"(?i)[-–—]{1,2}\s*(the )?(kirkus|publishers weekly|booklist|library journal|new york times|washington post|guardian|observer|locus|times literary supplement|entertainment weekly|people magazine|usa today|boston globe|san francisco chronicle|npr|the atlantic|\w+ review of books)\b"
READER_ADDRESS = r"(?i)^\s*\W*(don'?t miss|get ready (for|to)|if you (loved|liked|enjoyed)|perfect for (fans|readers|anyone)|a must[\s-]read for|you'?ll (love|never)|prepare to be)\b"
HEADING = r"^\s*[A-Z][^.!?]{0,60}:\s*$"
EDITION_SUBJECT = r"(?i)\bthis (\w+\s+)?(edition|volume|printing|reissue|impression|reprint)\b"
EDITION_VERB = r"(?i)\b(includes?|contains?|features?|reprints?|restores?|corrects?|adds?|presents?|reproduces?|incorporates?)\b"
EDITION_OBJECT = r"(?i)\b(introduction|notes?|index|appendix|appendices|illustrations?|translation|foreword|afterword|errata|revisions?|bibliography|glossary|preface|typography|annotations?)\b"
PRODUCT_VOICE = r"(?i)^\s*\W*(includes?|featuring|features?|contains?|presents?|offers?|provides?|collects?|compiles?|gathers?)\b"
BOOK_NOUN = r"(?i)\b(story|stories|novel|book|work|masterpiece|masterwork|portrait|account|saga|study|collection|memoir|biography|read|volume|epic|debut|prose|narrative|edition|anthology|classic)\b"
GENRE_NOUN = r"(?i)\b(action|suspense|adventure|mystery|romance|horror|fantasy|thriller|western|crime|noir|gothic|satire|comedy|tragedy|science fiction|historical|detective|espionage|dystopian)\b"
NARRATIVE_CLAUSE = r"(?i)\b(how|when|after|before|while|who|whose|where)\b\s+\w+"
PUBLICATION_NAMES = (
    r"(?i)#?\s*1?\s*new york times|n\.?y\.?\s+times|los angeles times|sunday times|times literary supplement|wall street journal|washington post|publishers?'? weekly|kirkus reviews?|"
    r"(school )?library journal|\bbooklist\b|usa today|entertainment weekly|\bbook review\b|oprah'?s book club|\bgoodreads\b|amazon\.com|barnes ?& ?noble|"
    r"(newly |fully |completely |thoroughly )?(revis\w+|updated)( and (revis\w+|updated))?(?=\s+(edition|version|and))"
)
#: Rules on unambiguous evidence, and the limits of the safety rail and of dense praise.
HARD_EVIDENCE = ["repeated_across_books", "isbn", "copyright", "url", "library_of_congress", "printed_in", "fiction_disclaimer", "social", "about_the_author", "cover_art", "page_count"]
MIN_KEPT_CHARS, MIN_KEPT_RATIO = 80, 0.25
DENSE_MIN, DENSE_STRONG, PLOT_EVIDENCE = 2.2, 3.0, -0.40


def _rule(s: Column, name: str, pattern: str) -> Column:
    return F.when(s.rlike("(?i)" + pattern), F.lit(name))


def _named(*tests: Column) -> Column:
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def strip_publications(c) -> Column:
    """Newspaper and magazine names deleted as phrases."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, PUBLICATION_NAMES, " "), r"\s{2,}", " "))


def register_score(s: Column, weights: Column) -> Column:
    """``mean, n, lowest`` of the weights of a sentence's words, with plain suffixes undone.

    ``weights`` is a map column from words to weights.
    """
    look = lambda w: F.coalesce(*[F.try_element_at(weights, F.regexp_replace(w, a, b) if a else w) for a, b in ENDINGS])
    found = F.filter(F.transform(F.regexp_extract_all(F.lower(s), F.lit("([a-z][a-z']+)"), F.lit(1)), look), lambda x: x.isNotNull())
    total = F.aggregate(found, F.lit(0.0), lambda a, x: a + x)
    return F.struct((total / F.nullif(F.size(found), F.lit(0))).alias("mean"), F.size(found).alias("n"), F.array_min(found).alias("lowest"))


def is_dense(s: Column, score: Column) -> Column:
    """Dense praise of the book itself: a high score, enough words, a book noun and no plot."""
    enough = (score["n"] >= 4) | ((score["n"] == 3) & (score["mean"] >= DENSE_STRONG))
    return F.coalesce((score["mean"] >= DENSE_MIN) & enough & (score["lowest"] > PLOT_EVIDENCE) & s.rlike(BOOK_NOUN) & ~s.rlike(NARRATIVE_CLAUSE) & ~s.rlike(GENRE_NOUN), F.lit(False))


ENDINGS = [("", ""), ("ies$", "y"), ("es$", ""), ("s$", ""), ("ing$", ""), ("ed$", ""), ("ly$", "")]
_SCORED = re.compile(r"[a-z][a-z']+")


def dense_rows(rows: DataFrame, sentence_col: str, weights: dict[str, float]) -> DataFrame:
    """Those of ``rows`` that :func:`is_dense` holds for, with ``mean`` and ``n`` of :func:`register_score`.

    A map column is searched from its start for every form of every word. Here the weights
    are a table by word, and sentences without a book noun or with plot are not scored.
    """
    s = F.col(sentence_col)
    likely = rows.where(s.rlike(BOOK_NOUN) & ~s.rlike(NARRATIVE_CLAUSE) & ~s.rlike(GENRE_NOUN))
    at, held = likely.columns.index(sentence_col), rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        known: dict[str, float | None] = {}

        def weight(w: str) -> float | None:
            if w not in known:
                forms = (re.sub(a, b, w) if a else w for a, b in ENDINGS)
                known[w] = next((x for f in forms if (x := held.value.get(f)) is not None), None)
            return known[w]

        for batch in batches:
            keep, means, counts = [], [], []
            for i, sentence in enumerate(batch.column(at).to_pylist()):
                found = [x for w in _SCORED.findall(sentence.lower()) if (x := weight(w)) is not None]
                if len(found) < 3:
                    continue
                total = 0.0
                for x in found:  # in order, as the column adds them
                    total += x
                mean = total / len(found)
                if mean >= DENSE_MIN and (len(found) >= 4 or mean >= DENSE_STRONG) and min(found) > PLOT_EVIDENCE:
                    keep.append(i)
                    means.append(mean)
                    counts.append(len(found))
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(means, pa.float64()), pa.array(counts, pa.int32())], names=[*part.schema.names, "mean", "n"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in likely.schema)
    return likely.mapInArrow(run, f"{kinds}, mean double, n int")


def flag_rows(rows: DataFrame, sentence_col: str, repeated_col: str | None = None, weights: Column | None = None, strict: bool = False) -> DataFrame:
    """``rows`` with ``rules``, ``kind`` (preface, postscript, any or null) and ``hard``."""
    s = F.col(sentence_col)
    out = rows.withColumn("_pre", _named(*[_rule(s, n, p) for n, p in PREFACE_RULES])).withColumn("_hard", _named(*[_rule(s, n, p) for n, p in HARD_POSTSCRIPT_RULES]))
    out = out.withColumn("_post", F.concat(_named(*[_rule(s, n, p) for n, p in POSTSCRIPT_RULES]), F.col("_hard")))
    repeated = F.lit(False) if repeated_col is None else F.coalesce(F.col(repeated_col), F.lit(False))
    dense = F.lit(False) if weights is None else is_dense(s, register_score(s, weights))
    either = _named(
        *[_rule(s, n, p) for n, p in FOOTER_RULES + JUNK_RULES],
        F.when(repeated, "repeated_across_books"),
        F.when(s.rlike(REVIEW_ATTRIBUTION) | s.rlike(REVIEW_SOURCE), "review_attribution"),
        F.when(s.rlike(READER_ADDRESS), "reader_address"),
        F.when(F.regexp_replace(F.trim(s), r"\s+", " ").rlike(HEADING), "heading_colon"),
        F.when(s.rlike(EDITION_SUBJECT) & s.rlike(EDITION_VERB) & s.rlike(EDITION_OBJECT), "edition_statement"),
        F.when(dense, "register_dense"),
    )
    out = out.withColumn("_any", either).withColumn("_weak", _named(F.when(s.rlike(PRODUCT_VOICE), "product_voice"), F.when(is_all_caps(s), "all_caps")))
    some = F.size("_pre") + F.size("_post") + F.size("_any") > 0
    weak = (F.size("_weak") > 0) & (some | F.lit(strict))
    kind = (
        F.when((F.size("_any") > 0) | weak | ((F.size("_pre") > 0) & (F.size("_post") > 0)), "any")
        .when(F.size("_pre") > 0, "preface").when(F.size("_post") > 0, "postscript")
    )
    rules = F.concat("_pre", "_post", "_any", F.when(weak, F.col("_weak")).otherwise(F.array().cast("array<string>")))
    return out.withColumn("rules", rules).withColumn("kind", kind).withColumn("hard", F.size("_hard") > 0).drop("_pre", "_post", "_hard", "_any", "_weak")


def bound(df: DataFrame, id_col: str, text_col: str, repeated: DataFrame | None = None, weights: Column | None = None, strict: bool = False) -> DataFrame:
    """Trimmed texts: ``id, bounded, lo, hi, n_sentences, fallback, removed``.

    ``lo`` and ``hi`` bound the kept sentences (from 0, ``hi`` exclusive). The start moves
    over prefaces and junk, the end back over postscripts and junk; the earliest heading
    that opens a postscript, other than the first sentence, cuts all that follows. A trim
    that keeps too little is undone unless every removal rests on hard evidence. ``repeated``
    has a column ``key`` of repeated sentences. ``removed`` lists position, rules and
    sentence. Null texts give no row.
    """
    rows = df.select(id_col, F.posexplode(lines_and_sentences(F.col(text_col))).alias("pos", "sentence"))
    if repeated is None:
        rows = rows.withColumn("_rep", F.lit(False))
    else:
        rows = rows.withColumn("_key", normalise(F.col("sentence"))).join(repeated.select(F.col("key").alias("_key"), F.lit(True).alias("_rep")), "_key", "left").drop("_key")
    flagged = flag_rows(rows, "sentence", "_rep", weights, strict)
    s = flagged.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "sentence", "kind", "rules", "hard"))).alias("s")).withColumn("n_sentences", F.size("s"))
    front = F.array_position(F.transform("s", lambda x: F.coalesce(x["kind"].isin("preface", "any"), F.lit(False))), False)
    back = F.array_position(F.reverse(F.transform("s", lambda x: F.coalesce(x["kind"].isin("postscript", "any"), F.lit(False)))), False)
    s = s.withColumn("lo", F.when(front == 0, F.col("n_sentences")).otherwise(front - 1).cast("int"))
    s = s.withColumn("hi", F.greatest(F.col("lo"), F.when(back == 0, F.lit(0)).otherwise(F.col("n_sentences") - back + 1)).cast("int"))
    cut_at = F.array_min(F.transform(F.filter("s", lambda x: x["hard"] & (x["pos"] >= 1) & (x["pos"] < F.col("hi"))), lambda x: x["pos"]))
    s = s.withColumn("hi", F.coalesce(cut_at, F.col("hi")))
    inside = lambda x: (x["pos"] >= F.col("lo")) & (x["pos"] < F.col("hi"))
    interior = lambda x: F.lit(strict) & F.coalesce(x["kind"] == "any", F.lit(False))
    removed = F.transform(F.filter("s", lambda x: (F.size(x["rules"]) > 0) & (~inside(x) | interior(x))), lambda x: F.struct(x["pos"].alias("pos"), F.array_join(x["rules"], ",").alias("rules"), x["sentence"].alias("sentence")))
    s = s.withColumn("removed", removed).withColumn("_kept", F.array_join(F.transform(F.filter("s", lambda x: inside(x) & ~interior(x)), lambda x: x["sentence"]), " "))
    s = s.withColumn("_all", F.array_join(F.transform("s", lambda x: x["sentence"]), " "))
    little = (F.length("_kept") < MIN_KEPT_CHARS) | (F.length("_kept") < MIN_KEPT_RATIO * F.length("_all"))
    evidence = F.forall("removed", lambda r: F.forall(F.split(r["rules"], ","), lambda n: n.isin(*HARD_EVIDENCE)))
    fallback = little & ~((F.size("removed") > 0) & evidence)
    return s.withColumn("fallback", fallback).select(id_col, F.when(F.col("fallback"), F.col("_all")).otherwise(F.col("_kept")).alias("bounded"), "lo", "hi", "n_sentences", "fallback", "removed")
