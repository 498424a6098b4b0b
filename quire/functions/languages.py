"""Language codes as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ISO 639-1 and 639-2 codes of the languages told apart here.
CODES = {
    "en": ("en", "eng"),
    "fr": ("fr", "fra", "fre"),
    "de": ("de", "deu", "ger"),
    "es": ("es", "spa"),
    "pt": ("pt", "por"),
    "it": ("it", "ita"),
    "nl": ("nl", "nld", "dut"),
}


def language_of_code(code: Column) -> Column:
    """The ISO 639-1 language a code names, in any case, with blanks or a region; else null.

    Codes of other languages, of several languages or of none give null: no text here can
    be in the language they name.
    """
    base = F.regexp_extract(F.lower(F.trim(code)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    pairs = [F.lit(x) for name, codes in CODES.items() for c in codes for x in (c, name)]
    return F.element_at(F.create_map(*pairs), base)
