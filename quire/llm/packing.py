"""Filling containers of fixed capacity with texts."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..runtime import cut
from .splitting import split_text
from .tokens import ATOM_TOKENS, DEFAULT_VOCABULARY, counter

#: Open windows one task keeps; more of them leave less unused space and cost more time.
OPENwindowS = 64

#: Partitions whose leftovers are packed together in one merging task.
MERGE_FAN_IN = 16

_PLACES = ("piece", "start", "end", "n_tokens")


class Packer:
    """Bounded-space best fit: a fixed number of open windows, the fullest leaves first."""

    def __init__(self, capacity: int, windows: int):
        self.capacity, self.windows = capacity, windows
        #: Open windows ``[used, items]``, the fullest first and of equal ones the oldest.
        self.open: list[list] = []
        self.fill: list[int] = []  # what they use, negative, so that it rises

    def add(self, size: int, items: list) -> tuple[int, list] | None:
        """Place items of a common size; the window that had to be closed for it, if any."""
        closed, held = None, list(items)
        at = bisect_left(self.fill, size - self.capacity)  # the fullest that has room
        if at < len(self.open):
            held = self.open.pop(at)[1]
            size -= self.fill.pop(at)
            held.extend(items)
        elif len(self.open) >= self.windows:
            closed = self.open.pop(0)
            self.fill.pop(0)
        to = bisect_right(self.fill, -size)
        self.fill.insert(to, -size)
        self.open.insert(to, [size, held])
        return closed


def _batch(rows: list[tuple[int, bool, list]], item: pa.StructType) -> pa.RecordBatch:
    used, still, items = zip(*rows) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(still, pa.bool_()), pa.array(items, pa.list_(item))], names=["used", "open", "items"])


def pack(
    df: DataFrame,
    id_col: str,
    text_col: str,
    capacity: int,
    vocabulary: str = DEFAULT_VOCABULARY,
    windows: int = OPENwindowS,
) -> DataFrame:
    """Containers of at most ``capacity`` tokens that hold every text once.

    Each task packs what it reads, in the order read, without a shuffle. Only the windows
    still open at its end (at most ``windows`` a task) are gathered, by ``MERGE_FAN_IN``
    tasks at a time, and packed again as wholes, until one task has the rest. A text is cut
    only when it alone exceeds a container, then at natural boundaries without overlap.

    Result: ``container`` (named after its first item), ``position``, the id, ``piece``
    (1 for a whole text), ``start``, ``end``, ``n_tokens`` and ``used``. Null and empty
    texts need no room and get no row; repeated rows are items of their own. Ids keep their
    type, whatever it is; a null id is an id. Other columns are ignored.
    """
    items = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    packer, kind = Packer, items.schema["id"].dataType
    item = pa.struct([("id", to_arrow_type(kind)), *((n, pa.int32()) for n in _PLACES)])
    window = f"used int, open boolean, items array<struct<id: {kind.simpleString()}, {', '.join(f'{n}: int' for n in _PLACES)}>>"

    def first(batches):
        own, bins = counter(vocabulary), packer(capacity, windows)
        for batch in batches:
            done = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = own.count(text)
                parts = [(0, len(text), n)]
                if n > capacity:
                    parts = [p[:3] for p in split_text(text, capacity, 0, own)] if capacity > 4 * ATOM_TOKENS else _tiny(text, capacity, own)
                for i, (a, b, size) in enumerate(parts, 1):
                    out = bins.add(size, [{"id": key, "piece": i, "start": a, "end": b, "n_tokens": size}])
                    if out:
                        done.append((out[0], False, out[1]))
            yield _batch(done, item)
        yield _batch([(w[0], True, w[1]) for w in bins.open], item)

    def merge(last: bool):
        def run(batches):
            bins = packer(capacity, windows if not last else 1 << 30)
            for batch in batches:
                done = []
                rows = zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())
                for size, held in sorted(rows, key=lambda r: (-r[0], str(r[1][0]["id"]), r[1][0]["piece"])):
                    out = bins.add(size, held)
                    if out:
                        done.append((out[0], False, out[1]))
                yield _batch(done, item)
            yield _batch([(w[0], not last, w[1]) for w in bins.open], item)

        return run

    packed = cut(items.mapInArrow(first, window))
    closed, left, tasks = packed.where("not open"), packed.where("open"), items.rdd.getNumPartitions()
    while tasks > 1:
        tasks = -(-tasks // MERGE_FAN_IN)
        merged = left.repartition(tasks).mapInArrow(merge(tasks == 1), window)
        if tasks > 1:
            merged = cut(merged)
        closed, left = closed.unionByName(merged.where("not open")), merged.where("open")
    full = closed.unionByName(left)
    named = full.withColumn("container", F.concat_ws("-", F.coalesce(F.col("items")[0]["id"].cast("string"), F.lit("none")), F.col("items")[0]["piece"].cast("string")))
    each = named.select("container", "used", F.posexplode("items").alias("position", "item"))
    return each.select("container", (F.col("position") + 1).alias("position"), F.col("item.id").alias(id_col), "item.piece", "item.start", "item.end", "item.n_tokens", "used")


def _tiny(text: str, capacity: int, own) -> list[tuple[int, int, int]]:
    """Cuts for capacities too small for the boundary search: as many characters as fit."""
    parts, a = [], 0
    while a < len(text):
        b = min(len(text), a + capacity)
        while b - a > 1 and own.count(text[a:b]) > capacity:
            b -= 1
        parts.append((a, b, own.count(text[a:b])))
        a = b
    return parts
