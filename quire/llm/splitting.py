"""Cutting oversized texts at natural boundaries."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import ATOM_TOKENS, DEFAULT_VOCABULARY, Counter, counter

#: Boundaries from coarse to fine; a match ends where the next piece may begin.
SEPARATORS = [
    ("section", regex.compile(r"\f+|\n\s*(?:[-*_=~] ?){3,}\s*\n+|\n+(?=\s*#{1,6}\s)|\n\s*\n(?=\s*(?:chapter|part|book|section|kapitel|chapitre|cap[ií]tulo|capitolo|hoofdstuk)\b)", regex.I)),
    ("paragraph", regex.compile(r"\n[^\S\n]*\n\s*|</p>\s*|(?:<br\s*/?>\s*){2,}")),
    ("sentence", regex.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]|\n+|<br\s*/?>\s*")),
    ("word", regex.compile(r"\s+")),
    ("character", None),
]
LEVELS = [name for name, _ in SEPARATORS]


def _bounds(text: str, starts: list[int], level: int) -> list[int]:
    """The atoms at which a new unit of a level begins."""
    pattern = SEPARATORS[level][1]
    if pattern is None:
        return list(range(len(starts)))
    ends = (m.end() for m in pattern.finditer(text))
    return sorted({bisect_right(starts, e) - 1 for e in ends if e < len(text)} - {0, -1})


def split_text(text: str, limit: int, overlap: int, own: Counter) -> list[tuple[int, int, int, str, int]]:
    """Pieces ``(start, end, tokens, level, shared)`` of one text, in order.

    A text within ``limit`` is one piece. ``level`` names the boundary that ends a piece
    (``end`` for the last) and ``shared`` counts the tokens a piece has in common with the
    one before: the shortest run of whole atoms with at least ``overlap`` tokens.
    """
    if limit <= overlap + 4 * ATOM_TOKENS:
        raise ValueError("the limit must leave room beside the overlap")
    slices, sizes = own.atoms(text)
    total = [0, *accumulate(sizes)]
    if total[-1] <= limit and (own.exact or own.count(text) <= limit):
        return [(0, len(text), own.count(text), "end", 0)] if text else []
    starts = [0, *accumulate(map(len, slices))]
    chars, n = starts, len(slices)
    bounds: dict[int, list[int]] = {}
    most = limit - overlap - 2 * ATOM_TOKENS  # a unit of this size fits beside any overlap

    units: list[tuple[int, int, int]] = []
    stack = [(0, n, 0, len(LEVELS))]
    while stack:
        lo, hi, level, ends = stack.pop()
        if total[hi] - total[lo] <= most or level == len(LEVELS):
            units.append((lo, hi, ends))
            continue
        if level not in bounds:
            bounds[level] = _bounds(text, starts[:-1], level)
        at = bounds[level]
        inner = at[bisect_right(at, lo) : bisect_right(at, hi - 1)]
        cuts = [lo, *inner, hi]
        for i in range(len(cuts) - 1, 0, -1):
            stack.append((cuts[i - 1], cuts[i], level + 1, ends if cuts[i] == hi else level))

    pieces = []
    lo = shared = k = 0
    while k < len(units):
        hi, level, first = units[k][1], units[k][2], k
        k += 1
        while k < len(units) and total[units[k][1]] - total[lo] <= limit:
            hi, level = units[k][1], units[k][2]
            k += 1
        tokens = own.count(text[chars[lo] : chars[hi]])
        while tokens > limit and k - 1 > first:  # merges across atoms may differ by a few tokens
            k -= 1
            hi, level = units[k - 1][1], units[k - 1][2]
            tokens = own.count(text[chars[lo] : chars[hi]])
        pieces.append((chars[lo], chars[hi], tokens, "end" if hi == n else LEVELS[level], shared))
        lo = hi
        while overlap and lo > 0 and total[hi] - total[lo] < overlap:
            lo -= 1
        shared = total[hi] - total[lo]
    return pieces


def split_oversized(
    df: DataFrame,
    id_col: str,
    text_col: str,
    max_tokens: int,
    overlap_tokens: int,
    vocabulary: str = DEFAULT_VOCABULARY,
) -> DataFrame:
    """Ordered pieces of every text above ``max_tokens``.

    One narrow pass without a shuffle. A text of at most ``max_tokens`` UTF-8 bytes cannot
    have more tokens than that, so only longer ones reach the tokenizer. Null and empty
    texts and texts within the limit give no row; repeated rows give their pieces again.
    Further columns of ``df`` are ignored, whatever their names.
    """
    long = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.octet_length("text") > max_tokens)
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, piece int, n_pieces int, start int, end int, n_tokens int, boundary string, shared_tokens int, piece_text string"

    def run(batches):
        own = counter(vocabulary)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pieces = split_text(text, max_tokens, overlap_tokens, own)
                if len(pieces) > 1:
                    rows += [(key, i, len(pieces), a, b, n, level, shared, text[a:b]) for i, (a, b, n, level, shared) in enumerate(pieces, 1)]
            kinds = [batch.schema.field(0).type, *[pa.int32()] * 5, pa.string(), pa.int32(), pa.string()]
            columns = list(zip(*rows)) or [[]] * 9
            names = [id_col, "piece", "n_pieces", "start", "end", "n_tokens", "boundary", "shared_tokens", "piece_text"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return long.mapInArrow(run, schema)
