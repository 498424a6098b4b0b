"""Word patterns for Python stages."""

from __future__ import annotations

import re

import regex

_LETTERS = regex.compile(r"\p{L}+").findall
_FAST = re.compile(r"[^\W\d_]+").findall
#: Characters outside Latin letters and common punctuation, for which the fast pattern is not proven equal.
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧‰-⁞]").search


def letter_runs(text: str) -> list[str]:
    r"""Maximal runs of ``\p{L}`` in lower case text."""
    text = text.lower()
    return _LETTERS(text) if _OTHER(text) else _FAST(text)
