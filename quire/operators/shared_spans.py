"""Long exact spans that stand in more than one text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, release

#: Characters the gear hash looks back on; 32 bits shifted once a character.
GEAR = 16

#: Texts with a chunk in common beyond which the chunk alone makes no pair, and the step in
#: which such a chunk is then lengthened on its left.
CROWDED, STEP = 32, 8

_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def chunk_margins(span: int) -> tuple[int, int, int]:
    """``(window, left, right)`` for spans of at least ``span`` characters.

    A cut is the least gear hash of some window of ``window`` characters. Inside a shared
    span, past one gear length and one window from either end, both texts have the same
    cuts. With ``window = (span + 3 - GEAR) // 4`` two consecutive cuts lie there, so the
    chunk between them, widened by ``left`` and ``right`` characters that the span is sure
    to contain, is the same in both texts: no shared span is missed.
    """
    window = (span + 3 - GEAR) // 4
    if window < 2:
        raise ValueError(f"spans must have at least {GEAR + 5} characters")
    return window, GEAR + window - 2, window


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def chunk_digests(texts: list[str], span: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the text and digest of every widened content-defined chunk."""
    return chunk_places(texts, span)[:2]


def chunk_places(texts: list[str], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same with where each widened chunk begins and ends in its text."""
    window, left, right = chunk_margins(span)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(chars)
    if n < window + GEAR:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    value = (chars.astype(np.uint64) + np.uint64(1)) * _MIX1
    value = (value ^ (value >> np.uint64(29))) * _MIX2
    gear = (value >> np.uint64(32)).astype(np.uint32)
    step = 1
    while step < GEAR:  # the sum of the last GEAR values, each shifted by its age
        gear[step:] = gear[step:] + (gear[:-step] << np.uint32(step))
        step *= 2
    mixed = gear * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    # least hash of every window, the last of equal ones
    key = (mixed.astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    width = 1
    while width * 2 <= window:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < window:
        key = np.minimum(key[: -(window - width)], key[window - width :])
    at = (np.uint64(0xFFFFFFFF) - (key & np.uint64(0xFFFFFFFF))).astype(np.int64)
    cuts = at[np.concatenate([[True], at[1:] != at[:-1]])]
    ends = np.cumsum(lengths)
    owner = np.searchsorted(ends, cuts[:-1], "right")
    lo, hi = cuts[:-1] - left, cuts[1:] + right
    ok = (lo >= ends[owner] - lengths[owner]) & (hi <= ends[owner])
    lo, hi, owner = lo[ok], hi[ok], owner[ok]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * _powers(_INVERSE, n), dtype=np.uint64)])
    digest = (sums[hi] - sums[lo]) * _powers(_BASE, n)[lo]
    digest = (digest ^ (digest >> np.uint64(31)) ^ (hi - lo).astype(np.uint64)) * _MIX1
    starts = (ends - lengths)[owner]
    return owner, digest, lo - starts, hi - starts


def longer_keys(text: str, lo: int, hi: int, span: int) -> list[tuple[int, int]]:
    """``(reach, key)`` of the lengthened chunks of a place, ``reach`` to the left of it.

    Two texts whose common span holds the chunk agree on ``a`` characters before and ``b``
    after it with ``a + b`` at least what the chunk lacks. They share the key of the largest
    multiple of ``STEP`` up to ``a``: it asks for as much less on the right, rounded so that
    ``b`` is sure to cover it.
    """
    lacks = max(0, span - (hi - lo))
    out = []
    for reach in range(0, lacks + 1, STEP):
        right = max(0, lacks - reach - STEP + 1)
        if reach <= lo and hi + right <= len(text):
            out.append((reach, xxhash.xxh64_intdigest(f"{reach}:{text[lo - reach : hi + right]}".encode("utf-8", "surrogatepass")) - (1 << 63)))
    return out


def whole_keys(text: str, lo: int, hi: int, reach: int, span: int) -> list[int]:
    """Keys of the windows of ``span`` characters that reach from ``reach`` to ``reach + STEP - 1`` left of a chunk."""
    lacks = max(0, span - (hi - lo))
    out = []
    for a in range(reach, min(reach + STEP, lacks + 1)):
        if a <= lo and hi + lacks - a <= len(text):
            out.append(xxhash.xxh64_intdigest(f"{a}={text[lo - a : hi + lacks - a]}".encode("utf-8", "surrogatepass")) - (1 << 63))
    return out


def shared_intervals(a: str, b: str, span: int) -> list[tuple[int, int, int, int]]:
    """Maximal stretches ``(a_start, a_end, b_start, b_end)`` of ``a`` that stand in ``b``.

    Every stretch of at least ``span`` characters of ``a`` is covered; each is paired with
    the first place in ``b``.
    """
    if len(a) < span or len(b) < span:
        return []
    places: dict[str, int] = {}
    for j in range(len(b) - span, -1, -1):
        places[b[j : j + span]] = j
    out, i = [], 0
    while i <= len(a) - span:
        j = places.get(a[i : i + span])
        if j is None:
            i += 1
            continue
        n = span
        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
            n += 1
        out.append((i, i + n, j, j + n))
        i += n - span + 1
    return out


def text_units(df: DataFrame, id_col: str, group_col: str, text_col: str, span: int) -> tuple[DataFrame, DataFrame]:
    """Distinct texts of a group, and the records that carry them.

    Returns ``units(unit, grp, text)`` for texts of at least ``span`` characters and
    ``members(unit, id)``. Of rows with the same id the greatest counts; a record without a
    group is a group of its own; null ids are no records.
    """
    record = df.select(F.col(id_col).alias("id"), F.col(group_col).cast("string").alias("g"), F.col(text_col).alias("text")).where("id is not null")
    record = record.groupBy("id").agg(F.max(F.struct("text", "g")).alias("r")).select("id", "r.text", F.coalesce(F.concat(F.lit("g"), F.col("r.g")), F.concat(F.lit("r"), F.col("id").cast("string"))).alias("grp"))
    record = record.where(F.length("text") >= span).withColumn("sha", F.sha2("text", 256))
    units = record.groupBy("grp", "sha").agg(F.min("id").alias("unit"), F.first("text").alias("text"))
    members = record.select("grp", "sha", "id").join(units.select("grp", "sha", "unit"), ["grp", "sha"]).select("unit", "id")
    return units.select("unit", "grp", "text"), members


def _in_several(rows: DataFrame) -> DataFrame:
    """``key, n``: keys of several groups, with the number of their places."""
    return rows.groupBy("key").agg(F.min("grp").alias("_a"), F.max("grp").alias("_b"), F.count(F.lit(1)).alias("n")).where("_a <> _b").select("key", "n")


def _meeting_places(units: DataFrame, chunks: DataFrame, span: int) -> DataFrame:
    """``key, unit, grp``: distinct places of chunks, lengthened where many texts have the chunk.

    A sentence shorter than ``span`` may stand in any number of texts and makes no pair. A
    chunk in more than ``CROWDED`` places is therefore lengthened in steps, and what is
    still crowded then is cut into windows of ``span`` characters, which form wanted pairs only.
    """
    kind = units.schema["unit"].dataType.simpleString()
    several = cut(_in_several(chunks))
    held = chunks.join(several, "key")
    places = held.where(F.col("n") <= CROWDED).select("key", "unit", "grp")
    if several.where(F.col("n") > CROWDED).isEmpty():
        found = cut(places.distinct())
        release(several)
        return found

    def lengthen(batches):
        for batch in batches:
            rows = []
            for key, unit, grp, lo, hi, text in zip(*(batch.column(i).to_pylist() for i in range(6))):
                rows += [(k, unit, grp, lo, hi, reach) for reach, k in longer_keys(text, lo, hi, span)]
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64(), batch.schema.field(1).type, pa.int64(), *[pa.int32()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["key", "unit", "grp", "lo", "hi", "reach"])

    def windows(batches):
        for batch in batches:
            rows = []
            for unit, grp, lo, hi, reach, text in zip(*(batch.column(i).to_pylist() for i in range(6))):
                rows += [(k, unit, grp) for k in whole_keys(text, lo, hi, reach, span)]
            columns = list(zip(*rows)) or [[]] * 3
            kinds = [pa.int64(), batch.schema.field(0).type, pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["key", "unit", "grp"])

    texts = units.select("unit", "text")
    crowded = held.where(F.col("n") > CROWDED).join(texts, "unit").select("key", "unit", "grp", "lo", "hi", "text")
    longer = cut(crowded.mapInArrow(lengthen, f"key bigint, unit {kind}, grp bigint, lo int, hi int, reach int"))
    still = longer.join(_in_several(longer), "key")
    exact = still.where(F.col("n") > CROWDED).join(texts, "unit").select("unit", "grp", "lo", "hi", "reach", "text").mapInArrow(windows, f"key bigint, unit {kind}, grp bigint")
    exact = exact.join(_in_several(exact).select("key"), "key", "left_semi")
    found = cut(places.unionByName(still.where(F.col("n") <= CROWDED).select("key", "unit", "grp")).unionByName(exact.select("key", "unit", "grp")).distinct())
    release(several, longer)
    return found


def shared_unit_pairs(units: DataFrame, span: int, slice_chars: int = 1_000_000) -> DataFrame:
    """Verified stretches ``unit_a, unit_b, a_start, a_end, b_start, b_end`` across groups.

    Content-defined chunks are deduplicated by digest; only digests that occur in several
    groups go on, lengthened where they are crowded. Within a key the heaviest group meets
    the others and the others meet each other, so the pairs formed are of the order of those
    wanted and never the square of one hot group or of one short sentence. Every candidate
    is compared exactly.
    """

    def digests(batches):
        for batch in batches:
            keys, groups, texts = (batch.column(i) for i in range(3))
            texts = texts.to_pylist()
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size < slice_chars):
                    size += len(texts[j])
                    j += 1
                owner, digest, lo, hi = chunk_places(texts[i:j], span)
                at = pa.array(owner + i)
                columns = [pa.array(digest.view(np.int64)), keys.take(at), groups.take(at), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "unit", "grp", "lo", "hi"])
                i = j

    kind = units.schema["unit"].dataType.simpleString()
    chunks = cut(units.select("unit", F.xxhash64("grp").alias("grp"), "text").mapInArrow(digests, f"key bigint, unit {kind}, grp bigint, lo int, hi int"))
    hot = _meeting_places(units, chunks, span)
    sizes = hot.groupBy("key", "grp").agg(F.count(F.lit(1)).alias("n"))
    heaviest = sizes.groupBy("key").agg(F.max(F.struct("n", "grp"))["grp"].alias("top"))
    marked = hot.join(heaviest, "key").withColumn("in_top", F.col("grp") == F.col("top")).drop("top")
    left = marked.select("key", F.col("unit").alias("ua"), F.col("grp").alias("ga"), F.col("in_top").alias("ta"))
    right = marked.where("not in_top").select("key", F.col("unit").alias("ub"), F.col("grp").alias("gb"))
    met = left.join(right, "key").where("ga <> gb and (ta or ua < ub)")
    pairs = cut(met.select(F.least("ua", "ub").alias("unit_a"), F.greatest("ua", "ub").alias("unit_b")).distinct())
    release(chunks, hot)
    a = units.select(F.col("unit").alias("unit_a"), F.col("text").alias("text_a"))
    b = units.select(F.col("unit").alias("unit_b"), F.col("text").alias("text_b"))

    def verify(batches):
        for batch in batches:
            rows = []
            for ua, ub, ta, tb in zip(*(batch.column(i).to_pylist() for i in range(4))):
                rows += [(ua, ub, *s) for s in shared_intervals(ta, tb, span)]
                if ta != tb:
                    rows += [(ub, ua, *s) for s in shared_intervals(tb, ta, span)]
                elif rows and rows[-1][:2] == (ua, ub):
                    rows.append((ub, ua, 0, len(tb), 0, len(ta)))
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [batch.schema.field(0).type] * 2 + [pa.int32()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["unit", "other", "start", "end", "other_start", "other_end"])

    joined = pairs.join(a, "unit_a").join(b, "unit_b").select("unit_a", "unit_b", "text_a", "text_b")
    return joined.mapInArrow(verify, f"unit {kind}, other {kind}, start int, end int, other_start int, other_end int")


def shared_pairs(df: DataFrame, id_col: str, group_col: str, text_col: str, span: int = 200) -> DataFrame:
    """Record pairs ``id_a < id_b`` of different groups with ``span`` characters in common.

    Copies of a text within a group are compared once and expanded at the end. Null, empty
    and shorter texts pair with nothing.
    """
    units, members = text_units(df, id_col, group_col, text_col, span)
    found = shared_unit_pairs(units, span).where("unit < other").select("unit", "other").distinct()
    a = members.select("unit", F.col("id").alias("x"))
    b = members.select(F.col("unit").alias("other"), F.col("id").alias("y"))
    return found.join(a, "unit").join(b, "other").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def shared_share(df: DataFrame, id_col: str, group_col: str, text_col: str, span: int = 200) -> DataFrame:
    """For each record how much of its text stands in other groups.

    ``id, n_chars, shared_chars, share, n_spans, n_texts`` for every record with a shared
    span; overlapping spans count once and ``n_texts`` counts the distinct texts of other
    groups that share.
    """
    units, members = text_units(df, id_col, group_col, text_col, span)
    spans = cut(shared_unit_pairs(units, span))
    before = Window.partitionBy("unit").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    running = Window.partitionBy("unit").orderBy("start", "end")
    flagged = spans.select("unit", "start", "end").distinct().withColumn("_reach", F.max("end").over(before))
    islands = flagged.withColumn("_island", F.sum(F.when(F.col("_reach") >= F.col("start"), 0).otherwise(1)).over(running))
    merged = islands.groupBy("unit", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    shared = merged.groupBy("unit").agg(F.sum(F.col("end") - F.col("start")).alias("shared_chars"), F.count(F.lit(1)).alias("n_spans"))
    partners = spans.groupBy("unit").agg(F.countDistinct("other").alias("n_texts"))
    sizes = units.select("unit", F.length("text").alias("n_chars"))
    per_unit = shared.join(partners, "unit").join(sizes, "unit")
    return per_unit.join(members, "unit").select("id", "n_chars", "shared_chars", (F.col("shared_chars") / F.col("n_chars")).alias("share"), "n_spans", "n_texts")
