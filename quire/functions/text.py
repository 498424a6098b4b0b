"""Text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .latin import LATIN_ACCENTS, LATIN_PLAIN

#: English stop words of the text statistics.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from "
    "further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours "
    "ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we were what when "
    "where which while who whom why will with you your yours yourself yourselves"
).split()


def collapse(c) -> Column:
    """Trimmed, with runs of white space as one blank."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalise(c) -> Column:
    """Trimmed lower case with single blanks; the key under which texts and sentences are equal."""
    return collapse(F.lower(c))


def words(c) -> Column:
    """Words between white space, without empty ones."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def fold(c) -> Column:
    """Lower case without the accents of Latin letters."""
    return F.translate(F.lower(c), LATIN_ACCENTS, LATIN_PLAIN)


def name_tokens(c) -> Column:
    """Identity tokens of a name: without accents, dots, case and punctuation."""
    return F.regexp_extract_all(F.regexp_replace(fold(c), r"\.", ""), F.lit("([a-z0-9]+)"), F.lit(1))


def title_key(c) -> Column:
    """Titles with the same key are the same: no accents, punctuation or case."""
    return collapse(F.regexp_replace(fold(c), "[^a-z0-9 ]", " "))


def strip_tags(c) -> Column:
    """Markup tags replaced by a blank."""
    return F.regexp_replace(c, "<[^>]+>", " ")


def clean_text(c, stop_words=STOP_WORDS) -> Column:
    """Lower case words without ASCII punctuation and stop words."""
    bare = F.regexp_replace(F.lower(c), r"[!-/:-@\[-`{-~]", " ")
    return F.array_join(F.filter(words(bare), lambda w: ~w.isin(*stop_words)), " ")


def year_in(c, last: int = 2019) -> Column:
    """The first year from 1500 to 20xx in a string; null where none or after ``last``."""
    found = F.regexp_extract(c, r"\b(1[5-9]\d{2}|20\d{2})\b", 1)
    year = F.when(found != "", found).cast("int")
    return F.when(year <= last, year)


def decade(year) -> Column:
    """The first year of the decade."""
    return (F.floor(F.col(year) / 10 if isinstance(year, str) else year / 10) * 10).cast("int")


def first_number(c) -> Column:
    """The first run of digits as a number, 0 where none."""
    found = F.regexp_extract(c, r"(\d+)", 1)
    return F.coalesce(F.when(found != "", found).cast("bigint"), F.lit(0).cast("bigint"))


def genre_names(c) -> Column:
    """Values of a genre map given as JSON, or as a literal in single quotes; else empty."""
    as_map = "map<string,string>"
    literal = F.regexp_replace(F.regexp_replace(c, r"(?<=[{\s,:])'|'(?=[,:}])", '"'), r"\\'", "'")
    return F.coalesce(F.map_values(F.from_json(c, as_map)), F.map_values(F.from_json(literal, as_map)), F.array().cast("array<string>"))


def slug(c) -> Column:
    """Lower case with runs of other characters as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def author_list(c) -> Column:
    """Names of a list with changing separators."""
    return F.filter(F.transform(F.split(c, r"\s*[,/&]\s*| and "), lambda x: F.trim(x)), lambda x: x != "")


def sentences(c) -> Column:
    """Sentences cut at white space after a full stop, exclamation or question mark."""
    return F.filter(F.transform(F.split(F.trim(c), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def lines_and_sentences(c) -> Column:
    """Sentences, also cut at line breaks."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def is_all_caps(c) -> Column:
    """At least 20 letters of which four in five are capitals."""
    letters, upper = F.regexp_count(c, F.lit(r"\p{L}")), F.regexp_count(c, F.lit(r"\p{Lu}"))
    return (letters >= 20) & (upper >= 0.8 * letters)


def content_words(c, stop_words=STOP_WORDS) -> Column:
    """Distinct words of more than two letters that are no stop words."""
    found = F.regexp_extract_all(F.lower(c), F.lit("([a-z][a-z']+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(*stop_words)))


def is_english_code(c) -> Column:
    """Empty, ``en``, ``eng`` or a regional form of it."""
    code = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return code.isin("", "en", "eng") | code.startswith("en-")


def looks_english(c, least: float = 0.10) -> Column:
    """No letter of a foreign script, at least eight words, enough English stop words."""
    tokens = F.regexp_extract_all(F.lower(c), F.lit("([a-z']+)"), F.lit(1))
    share = F.size(F.filter(tokens, lambda w: w.isin(*STOP_WORDS))) / F.greatest(F.size(tokens), F.lit(1))
    return ~c.rlike(r"[\x{0370}-\x{1FFF}\x{3040}-\x{9FFF}\x{AC00}-\x{D7AF}]") & (F.size(tokens) >= 8) & (share >= least)


def given_initials(tokens: Column) -> Column:
    """Initials of the given names; a short token without vowels is run-together initials."""
    given = F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))
    return F.array_join(F.transform(given, lambda t: F.when((F.length(t) <= 4) & ~t.rlike("[aeiouy]"), t).otherwise(F.substring(t, 1, 1))), "")


def is_spelled(tokens: Column) -> Column:
    """Whether a given name is written out."""
    given = F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))
    return F.exists(given, lambda t: (F.length(t) >= 3) & t.rlike("[aeiouy]"))


def signature(tokens: Column) -> Column:
    """Surname and initials; null for a single token."""
    return F.when(F.size(tokens) >= 2, F.concat_ws("|", F.element_at(tokens, -1), given_initials(tokens)))


#: Phrases kept as one word, joined before tokens are cut.
JOINED_PHRASES = ["new york", "science fiction", "world war", "united states", "high school", "young adult", "los angeles", "civil war", "best friend", "true love", "fairy tale", "serial killer", "ghost story"]


def join_phrases(c, phrases=JOINED_PHRASES) -> Column:
    """Phrases of several words with underscores; plain substrings, as in lower case text."""
    for p in phrases:
        c = F.replace(c, F.lit(p), F.lit(p.replace(" ", "_")))
    return c


def text_stats(text, cleaned=None) -> dict[str, Column]:
    """Seven statistics of a text; unique words come from the cleaned, totals from the raw text."""
    text = F.col(text) if isinstance(text, str) else text
    cleaned = clean_text(text) if cleaned is None else cleaned
    raw, unique = words(text), F.array_distinct(words(cleaned))
    n = F.size(raw)
    marks = F.size(F.filter(F.split(text, "[.!?]+"), lambda s: F.trim(s) != ""))
    return {
        "char_count": F.length(text),
        "word_count": n,
        "unique_words": F.size(unique),
        "lexical_diversity": F.size(unique) / F.nullif(n, F.lit(0)),
        "avg_word_len": F.length(F.array_join(raw, "")) / F.nullif(n, F.lit(0)),
        "sentence_count": marks,
        "avg_sent_len": n / F.nullif(marks, F.lit(0)),
    }
