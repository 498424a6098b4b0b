"""Accented Latin letters and their plain forms, derived from the Unicode tables."""

from __future__ import annotations

import unicodedata


def _plain(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


_PAIRS = [(chr(i), _plain(chr(i))) for i in range(0xC0, 0x250)]
_PAIRS = [(a, b) for a, b in _PAIRS if len(b) == 1 and b.isascii() and a != b]

#: Arguments of ``translate``: the letters of Latin-1 and Latin Extended with one plain letter each.
LATIN_ACCENTS = "".join(a for a, _ in _PAIRS)
LATIN_PLAIN = "".join(b for _, b in _PAIRS)
