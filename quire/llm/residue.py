"""Template residue, filler and delivery messages in text columns."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, release
from .residue_rules import record_matches

#: Limits of the check that follows a table hit. Texts of 40 to 80 characters with one to three
#: characters changed, whose similarity is 0.8 or more, differ in at most 16 bits in 998 of 1000 cases.
MAX_HAMMING = 16
MIN_SIMILARITY = 0.8

BITS = 64

#: Places of the table that counts in how many segments of the trusted side a run of four characters
#: stands; it only orders the runs (see :func:`telling_grams`), so two runs may share a place.
GRAM_PLACES = 1 << 20

#: Rows up to which the tables are used. Theirs grow with the product of the two sides; beyond, the
#: segments meet by the runs of :func:`telling_grams`. Both ways reach every pair within the limits.
TABLE_ROWS = 20_000_000

#: A placeholder inside a sentence condemns its record but is no pattern for others:
#: a label is trusted for propagation when the rule covers this share of the segment or is one
#: of a system's own messages.
TRUSTED_COVER = 0.4

#: Share of what the rule matched (its runs of four characters) that a near-duplicate must keep:
#: a sentence that a message was pasted into is no copy of the message once that is gone.
MIN_CORE = 0.5

SEGMENT = re.compile(r"(?<=[.!?…])\s+|\n+|<br ?/?>")
_VARIABLE = re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{4,}\b|\d+")
_NAME = re.compile(r"(?<=\S )[A-ZÀ-Þ][\w’'-]+")
_DIGIT = re.compile(r"\d")


@lru_cache(1 << 16)
def masked(segment: str) -> str:
    """A segment without what varies between copies of a message: numbers and names.

    Signs stay: a name in braces is a template's field, the name alone is a word.
    """
    if _DIGIT.search(segment):
        segment = _VARIABLE.sub("0", segment)
    return " ".join(_NAME.sub("N", segment).split()).lower()


def fingerprints(texts: list[str]) -> np.ndarray:
    """64-bit SimHash of each text over its runs of four characters."""
    out = np.zeros(len(texts), dtype=np.uint64)
    if not texts:
        return out
    padded = [f"  {t} " for t in texts]
    chars = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    ends = np.cumsum([len(t) for t in padded])
    begins = np.concatenate([[0], ends[:-1]])
    gram = chars.copy()
    for k in (1, 2, 3):
        gram[:-k] = gram[:-k] * np.uint64(0x100000001B3) + chars[k:]
    gram = (gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    gram = (gram ^ (gram >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    gram ^= gram >> np.uint64(31)
    inside = np.ones(len(gram), dtype=np.int32)  # grams that run over the end of their text do not vote
    for k in (1, 2, 3):
        inside[ends - k] = 0
    voters = np.add.reduceat(inside, begins)
    for bit in range(BITS):
        votes = np.add.reduceat(((gram >> np.uint64(bit)) & np.uint64(1)).astype(np.int32) * inside, begins)
        out |= (2 * votes > voters).astype(np.uint64) << np.uint64(bit)
    return out


def grams(text: str) -> set[str]:
    """The different runs of four characters."""
    return {text[i : i + 4] for i in range(max(1, len(text) - 3))}


def gram_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The different runs of four characters as numbers of 40 bits, with the index of their text before, in its order."""
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = [t + "\0\0\0" for t in texts]
    chars = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(t) for t in padded])
    code = chars[:-3].copy()
    for k in (1, 2, 3):
        code = code * np.uint64(0x100000001B3) + chars[k : len(chars) - 3 + k]
    code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    code ^= code >> np.uint64(32)
    owner = np.repeat(np.arange(len(texts)), sizes)[:-3]
    place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)[:-3]
    inside = place < np.maximum(1, sizes - 6)[owner]  # runs over the end of a text count where it is shorter than four only
    mask = (1 << 40) - 1
    both = np.sort(owner[inside] << 40 | (code[inside] & np.uint64(mask)).astype(np.int64))
    both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    return both >> 40, both & mask


def telling_grams(texts: list[str], held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the text and number of those runs of four characters by which it must meet its near-duplicates.

    Of two sets that share ``MIN_SIMILARITY`` of their union, each has all but a fifth of its
    own in common with the other; whatever the order, their first fifths (and one more)
    share a run. The order is by ``held``, in how many segments of the trusted side a run
    stands, so the few that tell most come first, and a text with more than a fifth that
    no trusted segment has is left out at once.
    """
    owner, code = gram_codes(texts)
    sizes = np.bincount(owner, minlength=len(texts))
    first = sizes - np.ceil(MIN_SIMILARITY * sizes - 1e-9).astype(np.int64) + 1
    weight = held[code % len(held)].astype(np.int64)
    may = np.bincount(owner[weight == 0], minlength=len(texts)) < first
    keep = may[owner]
    owner, code, weight = owner[keep], code[keep], weight[keep]
    order = np.lexsort((code, weight, owner))
    begins = np.cumsum(np.bincount(owner, minlength=len(texts)))
    begins = np.concatenate([[0], begins[:-1]])
    early = np.arange(len(order)) - begins[owner[order]] < first[owner[order]]
    order = order[early & (weight[order] > 0)]
    return owner[order], code[order]


def similarity(a: str, b: str) -> float:
    """Jaccard similarity of the runs of four characters."""
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def keeps_core(seg: str, core: str) -> bool:
    """Whether a segment still has most of what the rule matched in the segment it resembles."""
    wanted = grams(core)
    return len(wanted & grams(seg)) >= MIN_CORE * len(wanted)


def size_classes(texts: list[str]) -> np.ndarray:
    """A class for the number of different runs of four characters of each text.

    Texts of similarity ``MIN_SIMILARITY`` are in the same class or in neighbouring ones.
    """
    sizes = np.array([len(grams(t)) for t in texts], dtype=float)
    return np.floor(np.log(sizes) / np.log(1.0001 / MIN_SIMILARITY)).astype(np.int32)


def partitions(n_open: int, n_frontier: int) -> int:
    """Into how many blocks the fingerprints are cut, one table each.

    Two fingerprints that differ in at most ``MAX_HAMMING`` bits differ in at most
    ``MAX_HAMMING // blocks`` bits of some block, so a table that is probed with all such
    changes of the frontier's block misses none of them. Fewer, wider blocks need more
    probes and give fewer chance meetings; which costs less depends on the two sizes, and
    the width of a slot grows with them.
    """
    return min(range(4, MAX_HAMMING + 2), key=lambda blocks: table_rows(blocks, n_open, n_frontier))


def table_rows(blocks: int, n_open: int, n_frontier: int) -> float:
    """Rows of both sides of the tables and of their chance meetings."""
    width, probes = BITS // blocks, _probes(blocks)
    return n_open * blocks + 3 * n_frontier * blocks * probes + n_open * n_frontier * blocks * probes / 2.0**width / 6


def _probes(blocks: int) -> int:
    return sum(comb(-(-BITS // blocks), k) for k in range(MAX_HAMMING // blocks + 1))


def table_slots(hashed: DataFrame, blocks: int, probing: bool) -> DataFrame:
    """``slot, hash``: the slots of each fingerprint in its size class.

    The probing side also takes the slots of all fingerprints nearby, in its own size class
    and in the two beside it.
    """
    edges = [t * BITS // blocks for t in range(blocks + 1)]

    def block_slots(t: int):
        a, b = edges[t], edges[t + 1]
        own = F.shiftrightunsigned("hash", a).bitwiseAND(F.lit((1 << (b - a)) - 1))
        if not probing:
            return F.array(own + F.lit(t << 20))
        changes = [sum(1 << i for i in bits) for k in range(MAX_HAMMING // blocks + 1) for bits in combinations(range(b - a), k)]
        return F.transform(F.expr(f"array({', '.join(f'{c}L' for c in changes)})"), lambda c: own.bitwiseXOR(c) + F.lit(t << 20))

    slots = [block_slots(t) for t in range(blocks)]
    placed = hashed.select("hash", "size").distinct().select("hash", F.explode(F.flatten(F.array(*slots))).alias("_s"), "size")
    classes = F.explode(F.array(*[F.col("size") + d for d in ((-1, 0, 1) if probing else (0,))]))
    return placed.select("hash", "_s", classes.alias("_c")).select(((F.col("_c") + 1).cast("bigint") * (1 << 25) + F.col("_s")).alias("slot"), "hash")


def gram_slots(hashed: DataFrame) -> DataFrame:
    """``slot, hash``: the runs of four characters by which each fingerprint's segment meets others."""
    return hashed.select(F.explode("grams").alias("slot"), "hash")


def gram_counts(segments: DataFrame) -> np.ndarray:
    """In how many segments the runs of each of the ``GRAM_PLACES`` places stand."""
    def count(batches):
        total = np.zeros(GRAM_PLACES, np.int64)
        for batch in batches:
            total += np.bincount(gram_codes(batch.column(0).to_pylist())[1] % GRAM_PLACES, minlength=GRAM_PLACES)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["place", "n"])

    found = segments.select("seg").mapInArrow(count, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(GRAM_PLACES, np.int32)
    out[found["place"].to_numpy()] = np.minimum(found["n"].to_numpy(), np.iinfo(np.int32).max)
    return out


def hash_segments(segments: DataFrame, held) -> DataFrame:
    """``segments`` with ``hash, size, grams``, without those that no trusted segment can resemble; ``held`` is the broadcast of :func:`gram_counts`."""
    names = [*segments.columns, "hash", "size", "grams"]

    def run(batches):
        for batch in batches:
            owner, code = telling_grams(batch.column(0).to_pylist(), held.value)
            rows, counts = np.unique(owner, return_counts=True)
            batch = batch.take(pa.array(rows))
            segs = batch.column(0).to_pylist()
            grams = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(code))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fingerprints(segs).view(np.int64)), pa.array(size_classes(segs)), grams], names=names)

    kinds = ", ".join(f"{c} string" for c in segments.columns)
    return segments.mapInArrow(run, f"{kinds}, hash bigint, size int, grams array<bigint>")


def residue_segments(df: DataFrame, id_col: str, text_col: str, matches=record_matches) -> DataFrame:
    """``id, family, via, evidence`` for every residue segment of every record.

    Each segment (sentence or line) is held against trusted rules; ``evidence`` is what the
    rule matched, or the near-duplicate segment. Segments that a rule covers well give their
    label to near-duplicates: masked segments meet in partitioned SimHash tables, or by the
    runs of characters that tell most where the tables would be large, a hit is
    verified by Hamming distance and text similarity, and labels spread from segment to
    segment until no component with a trusted member grows. Only the trusted side and what
    it reached probes the tables, never all pairs of a bucket.

    One record is one distinct non-null id (the greatest text counts where rows differ).
    Null, empty and blank texts have no segment; very long texts are cut into segments like
    any other.
    """
    kind = df.schema[id_col].dataType.simpleString()
    records = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null").groupBy("id").agg(F.max("text").alias("text")).where("length(trim(text)) > 0")

    def cut_segments(batches):
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = [s for s in SEGMENT.split(text) if s and not s.isspace()]
                for s, found in zip(parts, matches(parts)):
                    family, core, tells = found or (None, "", False)
                    trusted = family is not None and (tells or len(core) / max(1, len(s.strip())) >= TRUSTED_COVER)
                    rows.append((key, masked(s), family, masked(core) if trusted else None, (core or s) if family else None))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [batch.schema.field(0).type, *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["id", "seg", "family", "core", "evidence"])

    segments = cut(records.mapInArrow(cut_segments, f"id {kind}, seg string, family string, core string, evidence string"))
    ruled = segments.where("family is not null").select("id", "family", F.lit("rule").alias("via"), "evidence")
    distinct = segments.groupBy("seg").agg(F.max(F.when(F.col("core").isNotNull(), F.struct("family", "core"))).alias("label"), F.max(F.col("family").isNotNull()).alias("ruled")).select("seg", "label.family", "label.core", "ruled")
    # rows that a rule has already condemned without being trusted neither give nor take a label
    distinct = cut(distinct.where("family is not null or not ruled").select("seg", "family", "core"))
    frontier = distinct.where("family is not null")
    open_side = distinct.where("family is null").select("seg")

    def verify(batches):
        for batch in batches:
            segs, sources, _, cores = (c.to_pylist() for c in batch.columns)
            ok = pa.array([keeps_core(a, c) and similarity(a, b) >= MIN_SIMILARITY for a, b, c in zip(segs, sources, cores)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:]], names=["seg", "family", "core"]).filter(ok)

    reached = None
    while True:
        held = df.sparkSession.sparkContext.broadcast(gram_counts(frontier))
        sources, likely = (cut(hash_segments(side, held)) for side in (frontier, open_side))
        n_likely, n_sources = likely.count(), sources.count()
        if not n_likely:
            release(sources, likely)
            held.destroy()
            break
        blocks = partitions(n_likely, n_sources)
        if table_rows(blocks, n_likely, n_sources) <= TABLE_ROWS:
            slots = table_slots(likely, blocks, False), table_slots(sources, blocks, True)
        else:
            slots = gram_slots(likely), gram_slots(sources)
        near = F.bit_count(F.col("hash").bitwiseXOR(F.col("h"))) <= MAX_HAMMING
        met = slots[0].join(slots[1].withColumnRenamed("hash", "h"), "slot").where(near).select("hash", "h").distinct()
        hits = likely.join(met, "hash").join(sources.select(F.col("hash").alias("h"), F.col("seg").alias("source"), "family", "core"), "h").select("seg", "source", "family", "core")
        fresh = cut(hits.mapInArrow(verify, "seg string, family string, core string").groupBy("seg").agg(F.min(F.struct("family", "core")).alias("label")).select("seg", "label.family", "label.core"))
        release(sources, likely)
        held.destroy()
        if fresh.isEmpty():
            break
        reached = fresh if reached is None else reached.unionByName(fresh)
        frontier = fresh
        open_side = open_side.join(fresh, "seg", "left_anti")
    if reached is None:
        return ruled
    spread = segments.where("family is null").select("id", "seg").join(reached, "seg").select("id", "family", F.lit("near-duplicate").alias("via"), F.col("seg").alias("evidence"))
    return ruled.unionByName(spread)


def find_residue(df: DataFrame, id_col: str, text_col: str, matches=record_matches) -> DataFrame:
    """One row ``id, families, n_segments, via_rule, evidence`` for each record with residue.

    ``matches`` gives the trusted label of every segment of a record, see :func:`record_matches`.
    """
    found = residue_segments(df, id_col, text_col, matches).groupBy("id").agg(
        F.sort_array(F.collect_set("family")).alias("families"),
        F.count(F.lit(1)).alias("n_segments"),
        F.max(F.col("via") == "rule").alias("via_rule"),
        F.min("evidence").alias("evidence"),
    )
    return found.withColumnRenamed("id", id_col)


def exclude_residue(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``df`` whose record has no residue; rows with a null id stay."""
    return df.join(find_residue(df, id_col, text_col).select(id_col), id_col, "left_anti")
