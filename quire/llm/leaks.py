"""Held-out passages inside a corpus, found with a bounded number of word edits."""

from __future__ import annotations

import html
import re
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..runtime import cut

#: A passage counts from this many words, or as a whole when the item is shorter.
MIN_WORDS = 30

#: One word in this many may be changed, added or dropped.
WORDS_PER_EDIT = 8

#: Words of a piece; see :class:`Items` for why a passage always keeps one whole.
PIECE = 5

#: Passages to look for, as words and edits: one of them stands in every longer passage.
TARGETS = [(MIN_WORDS, MIN_WORDS // WORDS_PER_EDIT), *((m, m // WORDS_PER_EDIT) for m in (32, 40, 48, 56))]

#: Characters of held-out text that travel to the tasks at once; more goes in several blocks.
BLOCK_CHARS = 16_000_000

_BLOCK = re.compile(r"</?(?:br|p|div|li|ul|ol|tr|td|th|h[1-6]|blockquote)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_LINK = re.compile(r"\]\([^()\s]*\)")
_BROKEN = re.compile(r"(?<=\w)[-\u2010\u00ad]\s*\n\s*(?=\w)")
_MARKS = re.compile("[\u2018\u2019\u02bc\u00b4\u00ad\u200b\u200c\u200d\ufeff]")
_INNER = re.compile(r"(?<=[^\W_])[-\u2010\u2011](?=[^\W_])")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Words without case, punctuation, quoting, markup and line breaks."""
    if "<" in text:
        text = _TAG.sub("", _BLOCK.sub(" ", text))
    if "&" in text:
        text = html.unescape(text)
    if "](" in text:
        text = _LINK.sub(" ", text)
    if "\n" in text:
        text = _BROKEN.sub("", text)
    text = text.replace("'", "").replace("`", "")
    if not text.isascii():
        text = _MARKS.sub("", text)
    if "-" in text or "\u2010" in text or "\u2011" in text:
        text = _INNER.sub("", text)
    return _WORD.findall(text.lower())


def prefix_costs(pattern: list[int], words: list[int]) -> np.ndarray:
    """For every length j of a prefix of the pattern its least distance to a prefix of ``words``.

    Myers' bit-parallel recurrence over words, held at the first word of both: bit j of the
    vertical vectors says whether the distance rises or falls from pattern word j to the next.
    """
    m = len(pattern)
    least = np.arange(m + 1)
    if not m:
        return least
    masks: dict[int, int] = {}
    for j, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << j
    full = (1 << m) - 1
    pv, mv, ups, downs = full, 0, [], []
    for w in words:
        eq = masks.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = ((mv | ~(xh | pv)) << 1 | 1) & full
        mh = ((pv & xh) << 1) & full
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv
        ups.append(pv)
        downs.append(mv)
    if ups:
        bits = np.arange(m, dtype=np.uint64)
        steps = [((np.array(v, dtype=np.uint64)[:, None] >> bits) & np.uint64(1)).astype(np.int64) for v in (ups, downs)]
        costs = np.arange(1, len(ups) + 1)[:, None] + np.cumsum(steps[0] - steps[1], axis=1)
        least[1:] = np.minimum(least[1:], costs.min(axis=0))
    return least


class Items:
    """The held-out texts, cut into pieces by the pigeonhole principle.

    A text of fewer than ``MIN_WORDS`` words with an allowance of e edits is cut into e + 1
    pieces, of which an occurrence keeps one whole. Longer texts are cut every ``PIECE``
    words: each of the passages in ``TARGETS`` holds at least one piece more than it may
    have edits, wherever it begins. Longer passages need no look of their own: their
    allowance grows by one every eight words, so one of the parts of 32 to 56 words they
    divide into keeps within its own.
    """

    def __init__(self, rows: list[tuple]):
        self.ids, self.words, self.code = [], [], {}
        pieces: dict[int, list[tuple[int, int]]] = {}
        for key, text in rows:
            words = words_of(text or "")
            if not words:
                continue
            k = len(self.ids)
            self.ids.append(key)
            self.words.append([self.code.setdefault(w, len(self.code) + 1) for w in words])
            n = len(words)
            if n < MIN_WORDS:
                parts = n // WORDS_PER_EDIT + 1
                begins = [i * n // parts for i in range(parts)]
                for a, b in zip(begins, [*begins[1:], n]):
                    # of a longer piece its first words are looked up
                    pieces.setdefault(min(PIECE, b - a), []).append((k, a))
            else:
                pieces.setdefault(PIECE, []).extend((k, a) for a in range(0, n - PIECE + 1, PIECE))
        # different words that any passage of an item still has after its edits
        self.sets = [frozenset(w) for w in self.words]
        self.distinct = [min(len(set(w[s : s + m])) - e for m, e in self.targets(k) for s in range(len(w) - m + 1)) for k, w in enumerate(self.words)]
        self.keys = {}
        for q, at in pieces.items():
            grams = np.array([self.words[k][p : p + q] for k, p in at], dtype=np.uint64)
            key = grams[:, 0].copy()
            for j in range(1, q):
                key = _mix(key, grams[:, j])
            order = np.argsort(key, kind="stable")
            key, where = key[order], np.array(at, dtype=np.int64)[order]
            values, first, count = np.unique(key, return_index=True, return_counts=True)
            seen = np.zeros(1 << 20, dtype=bool)
            seen[(values >> np.uint64(44)).astype(np.int64)] = True
            self.keys[q] = (values, first, count, where, seen)

    def targets(self, k: int) -> list[tuple[int, int]]:
        """Lengths of the passages to look for, with their edits."""
        n = len(self.words[k])
        return [(n, n // WORDS_PER_EDIT)] if n < MIN_WORDS else [(m, e) for m, e in TARGETS if m <= n]

    def verify(self, k: int, words: list[int], p: int, x: int, q: int) -> bool:
        """Whether a passage of item k stands around its piece of ``q`` words at ``p``, found whole at word ``x``.

        The words before and after the piece are held against the document by Myers'
        distance, for all lengths at once; a passage may take any number of each.
        """
        mine, targets = self.words[k], self.targets(k)
        reach, most = targets[-1]
        a, b = max(0, p + q - reach), min(len(mine), p + reach)
        near = set(words[max(0, x - reach - most) : x + q + reach + most])
        if len(near & self.sets[k]) < self.distinct[k]:
            return False
        # a passage has all but its edits among the words nearby
        held = np.array(list(accumulate(map(near.__contains__, mine[a:b]), initial=0)))
        if not any(m <= b - a and (held[m:] - held[:-m] >= m - e).any() for m, e in targets):
            return False
        after = prefix_costs(mine[p + q : b], words[x + q : x + q + reach + most])
        before = prefix_costs(mine[a:p][::-1], words[max(0, x - reach - most) : x][::-1])
        for m, e in targets:
            left = np.arange(max(0, m - q - len(after) + 1), min(len(before), m - q + 1))
            if len(left) and (before[left] + after[m - q - left]).min() <= e:
                return True
        return False


def _mix(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + word
    return key * np.uint64(0xD6E8FEB86659FD93)


def leaks_in(texts: list[str | None], items: Items) -> list[tuple[int, int]]:
    """Pairs (index of the text, index of the item) of the texts that hold a passage."""
    code, flat, ends = items.code, [], []
    get = code.get
    for text in texts:
        if text:
            flat.extend(map(get, words_of(text), repeat(0)))
        ends.append(len(flat))
    words = np.array(flat, dtype=np.uint64)
    ends = np.array(ends, dtype=np.int64)
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    found: set[tuple[int, int]] = set()
    for q, (values, first, count, where, seen) in items.keys.items():
        if len(words) < q:
            continue
        key = words[: len(words) - q + 1].copy()
        for j in range(1, q):
            key = _mix(key, words[j : len(words) - q + 1 + j])
        at = np.flatnonzero(seen[(key >> np.uint64(44)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(values, key[at]), len(values) - 1)
        ok = values[slot] == key[at]
        at, slot = at[ok], slot[ok]
        doc = np.searchsorted(ends, at, "right")
        ok = at + q <= ends[doc]
        at, slot, doc = at[ok], slot[ok], doc[ok]
        if not len(at):
            continue
        times = count[slot]
        spread = np.repeat(np.arange(len(at)), times)
        inner = np.arange(len(spread)) - np.repeat(np.cumsum(times) - times, times)
        item_at = where[first[slot][spread] + inner]
        last, own = -1, []
        for d, x, k, p in zip(doc[spread].tolist(), (at - begins[doc])[spread].tolist(), *item_at.T.tolist()):
            if (d, k) in found:
                continue
            if d != last:  # the hits of a text come one after the other
                last, own = d, flat[begins[d] : ends[d]]
            if items.verify(k, own, p, x, q):
                found.add((d, k))
    return sorted(found)


def find_leaks(
    docs: DataFrame,
    doc_id: str,
    doc_text: str,
    held_out: DataFrame,
    item_id: str,
    item_text: str,
    slice_chars: int = 2_000_000,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Pairs of an item and a document that holds a passage of it.

    A passage is at least 30 consecutive words of the item, or all of a shorter item, with
    at most one word in eight changed, added or dropped; case, punctuation, spacing, line
    breaks, quoting and markup do not matter. Pigeonhole pieces of the items are looked up
    at every word of every document and a passage is confirmed with Myers' bit-parallel
    distance. The held-out set is a stated query set: it travels to the tasks, in blocks of
    about ``block_chars`` characters where it is larger, and every block meets the whole
    corpus, which is never shuffled.

    Ids keep their type, whatever it is; a null id is an id. Null and empty texts hold
    nothing, items without words are found nowhere; repeated documents or items give one
    row for each pair of ids. Other columns are ignored.
    """
    total = held_out.select(F.sum(F.length(item_text)).alias("n")).first()["n"] or 0
    blocks = -(-total // block_chars) or 1
    types = [to_arrow_type(held_out.schema[item_id].dataType), to_arrow_type(docs.schema[doc_id].dataType)]
    kinds = [held_out.schema[item_id].dataType.simpleString(), docs.schema[doc_id].dataType.simpleString()]
    out_names = [item_id, doc_id] if item_id != doc_id else [item_id, f"{doc_id}_2"]
    texts = held_out.select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).distinct()
    found = None
    for block in range(blocks):
        mine = texts.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block)
        items = docs.sparkSession.sparkContext.broadcast(Items([(r["id"], r["text"]) for r in mine.collect()]))

        def run(batches, items=items):
            own = items.value
            for batch in batches:
                keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                out, i = [], 0
                while i < len(texts):
                    j, size = i, 0
                    while j < len(texts) and (j == i or size < slice_chars):
                        size += len(texts[j] or "")
                        j += 1
                    out += [(own.ids[k], keys[i + d]) for d, k in leaks_in(texts[i:j], own)]
                    i = j
                columns = zip(*out) if out else ([], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=out_names)

        pairs = docs.select(doc_id, doc_text).mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in zip(out_names, kinds)))
        if blocks > 1:  # one block at a time is held
            pairs = cut(pairs)
            items.destroy()
        found = pairs if found is None else found.unionByName(pairs)
    return found.distinct()
