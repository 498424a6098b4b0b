"""Matching records of two sources that share no key."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..runtime import cut, cut_in_buckets, release
from .representatives import top_per_group

#: Attribute nodes of the graph; a record has a vector of so many dimensions for each.
ATTRIBUTES = {"title": 0, "person": 1, "name": 2}
DIMENSIONS = 64

#: Walks that a task trains on at once, records for each bucket of tokens where walks meet, and
#: holders of a token from which they are dealt to several buckets.
BLOCK_WALKS, BUCKET_RECORDS, MANY_HOLDERS = 30_000, 20_000, 100_000

#: Tokens drawn beforehand with which walks may leave a record that they enter by one of its tokens.
DRAWS = 2
WALKS, WALK_TOKENS, WINDOW, NEGATIVES, RATE = 2, 8, 2, 3, 0.025

#: Walks of a step of the training, and tokens drawn against each walk.
STEP_WALKS, NOISE = 160, 8

#: Leading directions removed from the trained vectors.
COMMON_DIRECTIONS = 2

#: What the tables hash: the attributes of a view, whose vectors stand side by side. A title or
#: an author alone makes no match and would crowd the slots.
VIEWS = ((2,), (1, 2), (0, 1), (0, 2))

#: Hyperplane tables of a view, neighbours probed beside a query's own slot, bits beyond the
#: logarithm of the records, and records of a slot beyond which it is split.
TABLES, PROBES, SPARE_BITS, CROWDED = 4, 3, 2, 64

#: Sign bits of each attribute that travel with a record, and the least sum of the two best
#: cosines they let expect; pairs that match have 1.6 and more, and a bit is worth about 0.1.
SKETCH_BITS = (20, 19, 22)
MIN_EXPECTED, MISSING = 1.0, 0.3

#: Names below this share of the weight of one rare name tell records apart no more than a title's
#: small words; what they could add to a pair is less than a sixteenth.
MIN_TRUST = 0.25

#: Sign bits of two sketches that may differ at all; 30 do by chance.
MAX_SIGN_BITS = 40

#: A name counts as evidence of its own up to this many records.
RARE_NAME = 60

#: Shared share of the shorter title from which titles count as alike.
TITLE_SHARE = 0.75

#: Years that two records of one book may lie apart.
YEAR_GAP = 2

#: Pairs of each kind that the curve of the confidence weighs as, at most; and by how much a pair must lead.
FIT_PAIRS, LEAD = 20_000, 0.15


def walk_sequences(records: list[list[tuple[int, int, float]]], rng: np.random.Generator) -> list[list[int]]:
    """Token sequences of random walks over the record-attribute-token graph.

    A record lists ``(attribute, token, weight)``. A step leaves the record by one of its
    attributes, each alike, then by one of the attribute's tokens by weight, and enters
    any record that has the token.
    """
    sizes = np.array([len(tokens) for tokens in records], dtype=np.int64)
    if not sizes.sum():
        return []
    attr, token, weight = (np.array(x) for x in zip(*(t for tokens in records for t in tokens)))
    owner = np.repeat(np.arange(len(records)), sizes)
    # each attribute of a record is left alike, each of its tokens by weight
    _, group = np.unique(np.stack([owner, attr.astype(np.int64)]), axis=1, return_inverse=True)
    share = weight / np.bincount(group, weights=weight)[group]
    ends = np.cumsum(sizes)
    running = np.concatenate([[0.0], np.cumsum(share)])
    before = running[ends - sizes]
    total = running[ends] - before
    # who holds each token, side by side
    names, number = np.unique(token.astype(np.int64), return_inverse=True)
    pairs = np.unique(np.stack([number, owner]), axis=1)
    held = np.bincount(pairs[0], minlength=len(names))
    first = np.cumsum(held) - held
    at = np.repeat(np.flatnonzero(sizes), WALKS)
    walks = np.empty((len(at), WALK_TOKENS), np.int64)
    for step in range(WALK_TOKENS):
        u, v = rng.random((2, len(at)))
        place = np.searchsorted(running, before[at] + u * total[at], "right") - 1
        place = np.clip(place, ends[at] - sizes[at], ends[at] - 1)
        walks[:, step] = names[number[place]]
        near = number[place]
        at = pairs[1][first[near] + (v * held[near]).astype(np.int64)]
    return walks.tolist()


def _add_rows(table: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """``table[at] += rows``, where places may come again."""
    order = np.argsort(at, kind="stable")
    begins = np.flatnonzero(np.concatenate([[True], at[order[1:]] != at[order[:-1]]]))
    sizes, places = np.diff(np.append(begins, len(at))), at[order[begins]]
    # places that come a few times take a row at a time, the others have theirs summed up
    few = 3
    for turn in range(few):
        here = np.flatnonzero(sizes > turn)
        table[places[here]] += rows[order[begins[here] + turn]]
    many = np.flatnonzero(sizes > few)
    if len(many):
        rest = np.arange(len(at)) - np.repeat(begins, sizes) >= few
        table[places[many]] += np.add.reduceat(rows[order[rest]], np.cumsum(sizes[many] - few) - (sizes[many] - few), axis=0)


def skip_grams(walks: np.ndarray, start: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Skip-gram with negative sampling over the walked numbers of tokens, from ``start`` on.

    All pairs of a walk are trained on at once. Its tokens share ``NOISE`` tokens drawn against
    them, which weigh together what ``NEGATIVES`` of its own would for each pair.
    """
    vectors, context = start.copy(), np.zeros_like(start)
    seen, counts = np.unique(walks, return_counts=True)
    noise = np.cumsum(counts**0.75)
    apart = np.abs(np.subtract.outer(np.arange(walks.shape[1]), np.arange(walks.shape[1])))
    close = (apart > 0) & (apart <= WINDOW)
    walks = walks[rng.permutation(len(walks))]
    for i in range(0, len(walks), STEP_WALKS):
        part = walks[i : i + STEP_WALKS]
        others = seen[np.searchsorted(noise, rng.random((len(part), NOISE)) * noise[-1])]
        beside = np.concatenate([part, others], axis=1)
        pairs = close & (part[:, :, None] != part[:, None, :])
        v, c = vectors[part], context[beside]
        error = 1 / (1 + np.exp(-(v @ c.transpose(0, 2, 1))))
        error[:, :, : part.shape[1]] -= 1
        error[:, :, : part.shape[1]] *= pairs
        error[:, :, part.shape[1] :] *= (pairs.sum(axis=2) * np.float32(NEGATIVES / NOISE)).astype(np.float32)[:, :, None]
        error *= np.float32(-RATE)
        _add_rows(vectors, part.reshape(-1), (error @ c).reshape(-1, DIMENSIONS))
        _add_rows(context, beside.reshape(-1), (error.transpose(0, 2, 1) @ v).reshape(-1, DIMENSIONS))
    return vectors


def without_common(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors without what all have in common, which tells no records apart and would crowd the slots."""
    vectors = vectors - vectors.mean(axis=0)
    top = np.linalg.svd(vectors.T @ vectors)[0][:, :COMMON_DIRECTIONS]
    return _unit(vectors - vectors @ top @ top.T)


def train_vectors(sequences: list[list[int]], size: int = 0, seed: int = 0) -> np.ndarray:
    """Vectors of tokens numbered from 0, at least ``size`` of them."""
    rng = np.random.default_rng(seed)
    size = max([size, *(max(s) + 1 for s in sequences)])
    vectors = (rng.standard_normal((size, DIMENSIONS)) / np.sqrt(DIMENSIONS)).astype(np.float32)
    if not sequences:
        return vectors
    walks = np.array(sequences)
    vectors, seen = skip_grams(walks, vectors, rng), np.unique(walks)
    vectors[seen] = without_common(vectors[seen])
    return _unit(vectors)


def _mixed(numbers: np.ndarray, salt: int = 0) -> np.ndarray:
    """Numbers of 64 bits that look random."""
    mixed = (numbers.view(np.uint64) + np.uint64(salt * 0x632BE59BD9B4E019 % 2**64)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def _chance(numbers: np.ndarray, salt: int) -> np.ndarray:
    return (_mixed(_mixed(numbers).view(np.int64), salt) >> np.uint64(11)) / float(1 << 53)


def _signs(tokens: np.ndarray) -> np.ndarray:
    """Unit vectors with the signs of the tokens' own hashes."""
    signs = np.unpackbits(np.ascontiguousarray(_mixed(tokens)).view(np.uint8).reshape(-1, 8), axis=1)
    return (signs.astype(np.float32) - np.float32(0.5)) * np.float32(2 / np.sqrt(DIMENSIONS))


def _weight(n_records: int) -> Column:
    """The squared log of the inverse share of all records that hold a token, and how often its own does.

    0 for a token that does not bridge. What few of a record's rows say (a slip in one of many editions) weighs little.
    """
    rarity = F.log(F.lit(float(max(2, n_records))) / F.least(F.col("df"), F.lit(max(1, n_records - 1))))
    return F.when(F.col("df").isNull(), 0.0).otherwise(F.pow(rarity, 2) * F.sqrt("n")).cast("float")


def _leaving(key: np.ndarray, attr: np.ndarray, w: np.ndarray, times: int, each_row: bool, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows drawn by and the rows drawn: ``times`` for each row, or for each record.

    The rows of a record, by attribute, lie side by side. It is left by any of its
    attributes, each alike, then by one of the attribute's tokens by weight.
    """
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(begins, len(key)))
    group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (attr[1:] != attr[:-1])]))
    running = np.concatenate([[0.0], np.cumsum(w / np.bincount(group, weights=w)[group])])
    who = np.repeat(np.arange(len(begins)), sizes) if each_row else np.arange(len(begins))
    rows = np.arange(len(key)) if each_row else begins
    who, rows = np.repeat(who, times), np.repeat(rows, times)
    first, last = begins[who], begins[who] + sizes[who]
    turn = np.tile(np.arange(times), len(who) // times)
    u = _chance(key[rows] + (rows - first) * 64 + turn, salt)
    place = np.searchsorted(running, running[first] + u * (running[last] - running[first]), "right") - 1
    return rows, np.clip(place, first, last - 1)


def _dealt(buckets: np.ndarray, kind: int, data: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Rows ``bucket, kind, data`` with the rows of numbers of each bucket."""
    order = np.argsort(buckets, kind="stable")
    found, begins = np.unique(buckets[order], return_index=True)
    return [(int(k), kind, np.ascontiguousarray(part).tobytes()) for k, part in zip(found, np.split(data[order], begins[1:]))]


_PACKED = "bucket int, kind int, data binary"


def _packed_rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "kind", "data"])


def walk_all(tokens: DataFrame, n_records: int, n_last: int) -> DataFrame:
    """Packed ``bucket, kind, data``: ``WALKS`` random walks from every record, each its key and ``WALK_TOKENS`` tokens.

    A walk leaves a record by a token and enters any record that has it. To leave that one it
    takes a token that was drawn for this record and the token it came by, so all that a
    walk needs next lies with its last token: the walks travel to the buckets of their last
    tokens, all walks one step at a time. A token of very many records has several buckets.
    At the end the walks are dealt to ``n_last`` buckets at random.
    """
    n_buckets = int(max(6, n_records // BUCKET_RECORDS))
    bridging = tokens.where("df is not null")
    hot = bridging.where(F.col("df") > MANY_HOLDERS).select("token", "df").distinct().toArrow().to_pandas().sort_values("token")
    hot_tokens, hot_parts = hot["token"].to_numpy(np.int64), 1 + hot["df"].to_numpy(np.int64) // MANY_HOLDERS

    def slot(token, number):
        """The part of a token that a holder or a walk comes to."""
        if not len(hot_tokens):
            return _mixed(token).view(np.int64)
        at = np.minimum(np.searchsorted(hot_tokens, token), len(hot_tokens) - 1)
        parts = np.where(hot_tokens[at] == token, hot_parts[at], 1)
        return (_mixed(token) + (_chance(number, 7) * parts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)

    bucket = lambda slots: (_mixed(slots, 3) % np.uint64(n_buckets)).astype(np.int64)

    def begin(batches):
        def out(key, attr, token, w):
            rows, drawn = _leaving(key, attr, w, DRAWS, True, 1)
            slots = slot(token, key)
            pool = np.column_stack([slots, token[drawn].reshape(-1, DRAWS)])
            rows, drawn = _leaving(key, attr, w, WALKS, False, 2)
            walk = key[rows] + np.tile(np.arange(WALKS), len(rows) // WALKS)
            walks = np.column_stack([walk, token[drawn]])
            return _packed_rows(_dealt(bucket(slots), 0, pool) + _dealt(bucket(slot(walks[:, 1].copy(), walk)), 1, walks))

        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy() for c in batch.columns])
                n += batch.num_rows
            if n >= 1 << 19:
                rows = [np.concatenate(c) for c in zip(*held)]
                whole = int((rows[0] != rows[0][-1]).sum())
                if whole:
                    yield out(*(c[:whole] for c in rows))
                held, n = [[c[whole:] for c in rows]], len(rows[0]) - whole
        if n:
            yield out(*(np.concatenate(c) for c in zip(*held)))

    rows = bridging.select(F.xxhash64("side", "id").alias("key"), F.col("attr").cast("int").alias("attr"), "token", _weight(n_records).cast("double").alias("w"))
    started = cut(rows.repartition("key").sortWithinPartitions("key", "attr", "token").mapInArrow(begin, _PACKED))
    walks = started.where("kind = 1")

    def gather(batches):
        held = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                held.setdefault(k, []).append(data)
        for k in list(held):
            stand = np.frombuffer(b"".join(held.pop(k)), np.int64).reshape(-1, 1 + DRAWS)
            yield _packed_rows([(k, 0, stand[np.lexsort(stand.T[::-1])].tobytes())])

    # all steps read the holders where they lie, only the walks move
    n_tables = max(n_buckets, int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pool = cut_in_buckets(started.where("kind = 0").repartition(n_tables, "bucket").mapInArrow(gather, _PACKED), n_tables, "bucket")

    def step(done: int):
        def run(held: pa.Table, group: pa.Table) -> pa.Table:
            stand, walk = (np.frombuffer(b"".join(t["data"].to_pylist()), np.int64).reshape(-1, width) for t, width in ((held, 1 + DRAWS), (group, 1 + done)))
            walk = walk[np.lexsort(walk.T)]
            last = walk[:, -1].copy()
            here = slot(last, walk[:, 0] + done - 1)
            low, high = (np.searchsorted(stand[:, 0], here, side) for side in ("left", "right"))
            pick = (_chance(walk[:, 0].copy(), 10 + done) * (high - low) * DRAWS).astype(np.int64)
            # a part of a token that no holder came to ends the walk's way: it stays with its token
            fresh = np.where(high > low, stand[np.minimum(low + pick // DRAWS, len(stand) - 1), 1 + pick % DRAWS], last) if len(stand) else last
            goes = np.column_stack([walk, fresh])
            to = bucket(slot(fresh.copy(), walk[:, 0] + done)) if done + 1 < WALK_TOKENS else (_mixed(walk[:, 0].copy(), 5) % np.uint64(n_last)).astype(np.int64)
            return pa.Table.from_batches([_packed_rows(_dealt(to, 1, goes))])

        return run

    for done in range(1, WALK_TOKENS):
        moved = cut(pool.groupBy("bucket").cogroup(walks.groupBy("bucket")).applyInArrow(step(done), _PACKED))
        if done > 1:
            release(walks)
        walks = moved
    release(started, pool)
    return walks


def fit_vectors(tokens: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``token, vector`` in steps of 1/127, from walks that begin at every record of both sides.

    Tasks train on blocks of the walks, all from the signs of the tokens' hashes; what
    each block adds to a token is summed up over all blocks. What all vectors have in common is
    taken from their sums, so the driver receives one row a task.
    """
    n_records = sum(counts.values())
    n_parts = max(6, -(-n_records * WALKS // BLOCK_WALKS))
    walks = walk_all(tokens, n_records, 8 * n_parts)

    def train(batches):
        def block(data):
            walk = np.frombuffer(b"".join(data), np.int64).reshape(-1, 1 + WALK_TOKENS)
            walk = walk[np.lexsort(walk.T)]
            names, numbers = np.unique(walk[:, 1:], return_inverse=True)
            start = _signs(names)
            gained = skip_grams(numbers.reshape(-1, WALK_TOKENS), start, np.random.default_rng(1)) - start
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array([x.tobytes() for x in gained.astype(np.float16)], pa.binary())], names=["token", "gained"])

        held, n = [], 0
        for batch in batches:
            for data in batch.column(2).to_pylist():
                held.append(data)
                n += len(data) // (8 + 8 * WALK_TOKENS)
                if n >= 2 * BLOCK_WALKS:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    def merge(batches):
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            token = batch.column(0).to_numpy()
            begins = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            names = token[begins]
            sums = np.add.reduceat(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float16).reshape(-1, DIMENSIONS).astype(np.float32), begins, axis=0)
            if kept is not None and kept[0] == names[0]:
                sums[0] += kept[1]
            elif kept is not None:
                names, sums = np.concatenate([[kept[0]], names]), np.concatenate([kept[1][None], sums])
            kept = names[-1], sums[-1]
            yield whole(names[:-1], sums[:-1])
        if kept is not None:
            yield whole(np.array([kept[0]]), kept[1][None])

    def whole(names, sums):
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array([x.tobytes() for x in _unit(_signs(names) + sums).astype(np.float16)], pa.binary())], names=["token", "vector"])

    gained = walks.repartition(n_parts, "bucket").mapInArrow(train, "token bigint, gained binary")
    found = cut(gained.repartition("token").sortWithinPartitions("token").mapInArrow(merge, "token bigint, vector binary"))
    release(walks)

    def floats(column):
        return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(-1, DIMENSIONS).astype(np.float32)

    def sums(batches):
        total = np.zeros((DIMENSIONS + 1, DIMENSIONS + 1))
        for batch in batches:
            v = np.column_stack([floats(batch.column(1)).astype(float), np.ones(batch.num_rows)])
            total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    total = sum((np.frombuffer(r["sums"]).reshape(DIMENSIONS + 1, -1) for r in found.mapInArrow(sums, "sums binary").collect()), np.zeros((DIMENSIONS + 1, DIMENSIONS + 1)))
    n = max(1.0, total[-1, -1])
    mean = total[-1, :-1] / n
    top = np.linalg.svd(total[:-1, :-1] - n * np.outer(mean, mean))[0][:, :COMMON_DIRECTIONS]

    def centre(batches):
        for batch in batches:
            v = floats(batch.column(1)) - mean
            whole = np.rint(_unit(v - v @ top @ top.T) * 127).astype(np.int8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in whole], pa.binary())], names=["token", "vector"])

    vectors = cut(found.mapInArrow(centre, "token bigint, vector binary"))
    release(found)
    return vectors


def vectors_of(tokens: np.ndarray, known: pa.Array) -> np.ndarray:
    """The trained vectors of tokens; one that no walk met, null in ``known``, has the signs of its own hash."""
    out = _signs(tokens)
    there = known.is_valid().to_numpy(zero_copy_only=False)
    out[there] = np.frombuffer(b"".join(known.drop_null().to_pylist()), np.int8).reshape(-1, DIMENSIONS) / np.float32(127)
    return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=-1, keepdims=True), 1e-9)


def _packed(vectors: np.ndarray) -> pa.Array:
    """Unit vectors of each attribute as bytes, in steps of 1/127."""
    whole = np.rint(vectors * 127).astype(np.int8).reshape(len(vectors), -1)
    return pa.array([x.tobytes() for x in whole], pa.binary())


def _unpacked(column: pa.Array) -> np.ndarray:
    """``(records, attributes, dimensions)``, each a unit vector or all zeros."""
    whole = np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(-1, len(ATTRIBUTES), DIMENSIONS)
    return _unit(whole.astype(np.float32))


_LISTS, _LISTS_SCHEMA = ["titles", "persons", "nt", "np"], "titles array<bigint>, persons array<bigint>, nt bigint, np bigint"


def record_vectors(tokens: DataFrame, model: DataFrame, n_records: int) -> DataFrame:
    """``side, id, trust, vector``: for each attribute the normalised sum of the vectors of all its tokens.

    ``titles`` and ``persons`` are the bridging tokens of title, the rarest first, and person;
    ``nt`` and ``np`` count those that do not bridge, too.
    ``trust`` says for each attribute what a cosine is worth: for titles and persons the root
    of the share of their tokens that bridge, for names the weight of the sum against that of
    one name of two holders, at most 1. It is negative where a record lacks the attribute.
    The rows of a record come one after the other and are summed as they pass, so a record
    with any number of names needs no more room than its vectors.
    """
    kind, id_type, n_attrs = tokens.schema["id"].dataType.simpleString(), to_arrow_type(tokens.schema["id"].dataType), len(ATTRIBUTES)
    one_name = max(1e-9, np.log(max(3, n_records) / 2) ** 2)

    def lists(n, rows):
        """The tokens of each of ``n`` records as lists, from rows ``record, df, token``."""
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(rows[:, 0], minlength=n))]).astype(np.int32)
        return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(rows[:, 2])))

    def out(keys, counts, block, rows):
        sides, ids = zip(*keys)
        trust = np.sqrt(counts[:, :, 1] / np.maximum(counts[:, :, 0], 1))
        name = ATTRIBUTES["name"]
        trust[:, name] = np.minimum(1, np.linalg.norm(block[:, name], axis=1) / one_name)
        trust[counts[:, :, 0] == 0] = -1
        offsets = np.arange(0, trust.size + 1, n_attrs, dtype=np.int32)
        columns = [pa.array(sides, pa.int32()), pa.array(ids, id_type), pa.ListArray.from_arrays(offsets, pa.array(trust.reshape(-1).astype(np.float32))), _packed(_unit(block))]
        listed = [ATTRIBUTES["title"], ATTRIBUTES["person"]]
        columns += [lists(len(keys), rows[rows[:, 3] == a][:, :3]) for a in listed] + [pa.array(counts[:, a, 0].astype(np.int64)) for a in listed]
        return pa.RecordBatch.from_arrays(columns, names=["side", "id", "trust", "vector", *_LISTS])

    def run(batches):
        key, seen, total, open_rows = None, None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            side, ids, attr, token, w, known, df = batch.columns
            side, attr, w = side.to_numpy(), attr.to_numpy(), w.to_numpy()
            coded = ids.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            fresh = np.concatenate([[True], (coded[1:] != coded[:-1]) | (side[1:] != side[:-1])])
            begins = np.flatnonzero(fresh | np.concatenate([[True], attr[1:] != attr[:-1]]))
            sums = np.add.reduceat(vectors_of(token.to_numpy(), known) * w[:, None], begins, axis=0)
            n = np.add.reduceat(np.stack([np.ones(len(w)), w > 0], axis=1), begins, axis=0)
            record = np.cumsum(fresh)[begins] - 1
            block, counts = np.zeros((record[-1] + 1, n_attrs, DIMENSIONS), np.float32), np.zeros((record[-1] + 1, n_attrs, 2))
            block[record, attr[begins]], counts[record, attr[begins]] = sums, n
            starts = np.flatnonzero(fresh)
            keys = list(zip(side[starts].tolist(), ids.take(pa.array(starts)).to_pylist()))
            rows = np.column_stack([np.cumsum(fresh) - 1, df.fill_null(0).to_numpy(), token.to_numpy(), attr])
            rows = rows[(attr != ATTRIBUTES["name"]) & df.is_valid().to_numpy(zero_copy_only=False)]
            if key == keys[0]:
                block[0] += total
                counts[0] += seen
                rows = np.concatenate([open_rows, rows])
            elif key is not None:
                keys, counts, block = [key, *keys], np.concatenate([seen[None], counts]), np.concatenate([total[None], block])
                rows = np.concatenate([open_rows, rows + [1, 0, 0, 0]])
            key, seen, total = keys[-1], counts[-1], block[-1]
            if len(keys) > 1:
                yield out(keys[:-1], counts[:-1], block[:-1], rows[rows[:, 0] < len(keys) - 1])
            open_rows = rows[rows[:, 0] == len(keys) - 1] * [0, 1, 1, 1]
        if key is not None:
            yield out([key], seen[None], total[None], open_rows)

    # one shuffle by id; the order makes the rows of a record neighbours (the id first, as it sorts fastest)
    rows = tokens.join(model, "token", "left").select("side", "id", F.col("attr").cast("int").alias("attr"), "token", _weight(n_records).alias("w"), "vector", "df").repartition("id").sortWithinPartitions("id", "side", "attr")
    return rows.mapInArrow(run, f"side int, id {kind}, trust array<float>, vector binary, {_LISTS_SCHEMA}")


def _planes(view: int, bits: int) -> np.ndarray:
    shape = (len(VIEWS[view]) * DIMENSIONS, TABLES * bits)
    return np.random.default_rng([view, bits]).standard_normal(shape).astype(np.float32)


def _telling(vectors: np.ndarray, trust: np.ndarray) -> np.ndarray:
    """The vectors without those of names that weigh too little."""
    vectors = vectors.copy()
    vectors[trust[:, ATTRIBUTES["name"]] < MIN_TRUST, ATTRIBUTES["name"]] = 0
    return vectors


def _trust(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(ATTRIBUTES))


def slots_of(vectors: np.ndarray, bits: int, probes: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows and slots of the records in the tables of every view they have all attributes of.

    A record stands in its own slot and in those of the ``probes`` bits it is least sure of.
    """
    present = np.abs(vectors).sum(axis=2) > 0
    out = []
    for view, attrs in enumerate(VIEWS):
        rows = np.flatnonzero(present[:, attrs].all(axis=1))
        side = vectors[rows][:, attrs].reshape(len(rows), len(attrs) * DIMENSIONS) @ _planes(view, bits)
        for t in range(TABLES):
            part = side[:, t * bits : (t + 1) * bits]
            own = ((part > 0) << np.arange(bits, dtype=np.int64)).sum(axis=1) | np.int64(view * TABLES + t) << 40
            order = np.argsort(np.abs(part), axis=1)[:, :probes]
            out += [(rows, own), *((rows, own ^ (np.int64(1) << order[:, j])) for j in range(order.shape[1]))]
    return out


def sketches_of(vectors: np.ndarray) -> np.ndarray:
    """Sign bits of each attribute side by side, then a bit for each attribute that is there."""
    out, at = np.zeros(len(vectors), np.int64), 0
    for attr, bits in enumerate(SKETCH_BITS):
        planes = np.random.default_rng(100 + attr).standard_normal((DIMENSIONS, bits)).astype(np.float32)
        signs = (vectors[:, attr] @ planes > 0).astype(np.int64)
        out |= (signs << np.arange(at, at + bits, dtype=np.int64)).sum(axis=1)
        at += bits
    return out | ((np.abs(vectors).sum(axis=2) > 0).astype(np.int64)[:, 1:] << np.arange(at, at + 2, dtype=np.int64)).sum(axis=1)


def with_sketches(vectors: DataFrame) -> DataFrame:
    """One side's ``id, trust, vector``, its lists of tokens and the ``sketch`` of each record."""
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            columns = [*batch.columns, pa.array(sketches_of(_telling(_unpacked(batch.column(2)), _trust(batch.column(1)))))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "trust", "vector", *_LISTS, "sketch"])

    return vectors.select("id", "trust", "vector", *_LISTS).mapInArrow(run, f"id {kind}, trust array<float>, vector binary, {_LISTS_SCHEMA}, sketch bigint")


def _expected(a: Column, b: Column) -> Column:
    """The sum of the two best cosines that two sketches let expect; ``MISSING`` for what one side lacks."""
    found, at, total = [], 0, sum(SKETCH_BITS)
    for attr, bits in enumerate(SKETCH_BITS):
        mask = F.lit(((1 << bits) - 1) << at)
        cosine = F.get(F.lit([float(np.cos(n * np.pi / bits)) for n in range(bits + 1)]), F.bit_count(a.bitwiseXOR(b).bitwiseAND(mask)))
        if attr:
            there = a.bitwiseAND(b).bitwiseAND(F.lit(1 << (total + attr - 1))) != 0
            cosine = F.when(there, cosine).otherwise(MISSING)
        found.append(cosine)
        at += bits
    return sum(found[1:], found[0]) - F.least(*found)


def _title_keys(lists: DataFrame, is_left: bool) -> DataFrame:
    """``id, sketch, slot``: a title token with a person's token or a year, for the joins of :func:`evidence_keys`."""
    each = lists.select("id", "sketch", "year", "persons", "nt", (F.col("np") == 0).alias("bare"), F.posexplode("titles").alias("_r", "t"))
    # two token sets that share so much of the smaller one share one of its rarest few
    pre = F.col("_r") <= F.col("nt") - F.ceil(F.lit(TITLE_SHARE) * F.col("nt"))
    titles = each.select("id", "sketch", "year", "persons", "bare", F.col("t").alias("token"), pre.alias("pre"))
    year = F.col("year").cast("bigint")
    years = F.sequence(year - YEAR_GAP, year + YEAR_GAP) if is_left else F.array(year)
    # in each join one side brings the rarest tokens only; those on years need a side without persons
    pre, bare, every = F.col("pre"), F.col("bare"), F.lit(True)
    by_person = [pre, every] if is_left else [every, pre]
    by_year = [bare & pre, bare, pre, every] if is_left else [every, pre, bare, bare & pre]
    parts = []
    for seconds, first, takes in ((F.col("persons"), 0, by_person), (F.when(year.isNotNull(), years), len(by_person), by_year)):
        joins = F.filter(F.array(*[F.when(t, F.lit(first + i)) for i, t in enumerate(takes)]), lambda x: x.isNotNull())
        rows = titles.select("id", "sketch", "token", joins.alias("joins"), F.explode(seconds).alias("second"))
        parts.append(rows.select("id", "sketch", "token", "second", F.explode("joins").alias("join")))
    return parts[0].unionByName(parts[1]).select("id", "sketch", F.xxhash64("join", "token", "second").alias("slot"))


def evidence_keys(left: DataFrame, right: DataFrame, left_info: DataFrame, right_info: DataFrame) -> list[DataFrame]:
    """``id, sketch, slot`` of each side: all pairs whose evidence can reach a match share a slot.

    The info frames have ``id, year, sketch`` and the lists of :func:`record_vectors`.
    A match needs a shared rare name, or a title of which ``TITLE_SHARE`` is shared along
    with a person's token or, where a side names no person, a year. A name has at most
    ``RARE_NAME`` holders, so its pairs are few however large the input is. Hyperplane
    tables lose a pair now and then, the more the larger the input is; these joins do not.
    """
    rare = (F.col("attr") == ATTRIBUTES["name"]) & (F.col("df") <= RARE_NAME)
    return [
        side.where(rare).select("id", F.xxhash64(F.lit("name"), "token").alias("slot")).join(info.select("id", "sketch"), "id").select("id", "sketch", "slot")
        .unionByName(_title_keys(info, is_left))
        for side, info, is_left in ((left, left_info, True), (right, right_info, False))
    ]


def candidates(records: list[DataFrame], n_right: int, further: list[DataFrame]) -> DataFrame:
    """Pairs ``left_id, right_id`` that share a slot, of some table or of ``further``, and may be alike in two attributes.

    ``records`` are those of each side, with their ``sketch``.
    Slots grow narrower with the number of records. A slot that is still crowded, as all
    its records have the same title, say, is split by the sign bits of the other attributes.
    """
    bits = int(np.clip(np.ceil(np.log2(max(2, n_right))) + SPARE_BITS, 6, 36))
    kind = records[0].schema["id"].dataType.simpleString()

    def place(probes: int):
        def run(batches):
            for batch in batches:
                v = _telling(_unpacked(batch.column(2)), _trust(batch.column(1)))
                sketch = batch.column(3).to_numpy()
                rows, slots = (np.concatenate(x) for x in zip(*slots_of(v, bits, probes)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(slots), pa.array(sketch[rows])], names=["id", "slot", "sketch"])

        return run

    own = [side.select("id", "trust", "vector", "sketch") for side in records]
    sides = [v.mapInArrow(place(p), f"id {kind}, slot bigint, sketch bigint") for v, p in zip(own, (PROBES, 0))]
    sides[1] = cut(sides[1])
    crowded = sides[1].groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWDED)
    crowded = cut(crowded.select("slot", F.least(F.ceil(F.log2(F.col("n") / CROWDED)), F.lit(30)).cast("int").alias("more")))

    def split(side: DataFrame) -> DataFrame:
        # each table takes other bits of the sketch
        turned = F.expr(f"shiftrightunsigned(sketch, cast(pmod(shiftright(slot, 40), {TABLES}) * 13 as int))")
        part = F.pmod(turned, F.expr("shiftleft(1L, more)"))
        return side.join(crowded, "slot", "left").select("id", F.when(F.col("more").isNull(), F.col("slot")).otherwise(F.xxhash64("slot", part)).alias("slot"), "sketch")

    if not crowded.isEmpty():
        sides = [split(side) for side in sides]
    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        a = left.select(F.col("id").alias("left_id"), "slot", F.col("sketch").alias("sl"))
        b = right.select(F.col("id").alias("right_id"), "slot", F.col("sketch").alias("sr"))
        return a.join(b, "slot")

    expected = _expected(F.col("sl"), F.col("sr")) >= MIN_EXPECTED
    near = meet(*sides).where((F.bit_count(F.col("sl").bitwiseXOR(F.col("sr"))) <= MAX_SIGN_BITS) & expected)
    return near.unionByName(meet(*further).where(expected)).select("left_id", "right_id").distinct()


def rerank(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Exact cosines ``title, person, name`` of each pair, each times the trust of both sides.

    Null for an attribute that one side lacks. ``left`` and ``right`` have ``id, trust,
    vector`` with the year and the volumes.
    """
    a = left.withColumnsRenamed({"id": "left_id", "vector": "vl", "year": "ly", "trust": "tl"})
    b = right.withColumnsRenamed({"id": "right_id", "vector": "vr", "year": "ry", "trust": "tr"})
    both = pairs.join(a, "left_id").join(b, "right_id")
    both = both.select("left_id", "right_id", (F.abs(F.col("ly") - F.col("ry"))).alias("gap"), _other_volume().alias("other_volume"), "tl", "tr", "vl", "vr")
    names = list(ATTRIBUTES)

    def run(batches):
        for batch in batches:
            x, y = _unpacked(batch.column(6)), _unpacked(batch.column(7))
            trust = [_trust(batch.column(i)).astype(np.float64) for i in (4, 5)]
            missing = np.minimum(*trust) < 0
            cosines = (x * y).sum(axis=2) * np.maximum(trust[0], 0) * np.maximum(trust[1], 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(cosines[:, i], mask=missing[:, i]) for i in range(len(names)))], names=["left_id", "right_id", "gap", "other_volume", *names])

    kinds = [f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("left_id", "right_id")]
    return both.mapInArrow(run, ", ".join([*kinds, "gap int", "other_volume boolean", *(f"{n} double" for n in names)]))


def _other_volume() -> Column:
    return F.col("volume").isNotNull() & ~F.coalesce(F.array_contains("volumes", F.col("volume")), F.lit(False))


def _features() -> list[Column]:
    """What the confidence is made of: the cosines, persons and names that both have but not the same, and the years."""
    cosines = [F.coalesce(F.col(c), F.lit(0.0)) for c in ATTRIBUTES]
    said = [F.col("person") < 0.25, F.col("name") < 0.25, F.col("gap") <= YEAR_GAP, F.col("gap") > YEAR_GAP]
    return [*cosines, *(F.coalesce(c.cast("double"), F.lit(0.0)) for c in said)]


def match_records(left: DataFrame, right: DataFrame, left_info: DataFrame, right_info: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """The best match ``left_id, right_id, confidence, cosine, title, person, name, gap`` of each left record.

    ``left`` and ``right`` have rows ``id, attr, token`` with the attributes ``title``,
    ``person`` and ``name``; the info frames have ``id, year, volume`` (``volumes`` on the
    right, an array). Random walks over the graph of records, attributes and tokens train
    skip-gram vectors of the tokens. Each attribute of every record has the sum of the
    vectors of its tokens; hyperplane tables over these and exact joins on shared evidence
    give candidates, which are reranked by their exact cosines. The confidence is a logistic curve through the cosines and the
    agreement of the years, fitted on pairs that are each other's nearest by a clear lead.
    A pair of two volumes of a series is left out at the end.

    A left record has at most one match; ties go to the higher cosine, then the smaller id.
    Null ids, empty records and records without a shared token match nothing; repeated rows
    count as further evidence for their tokens. An empty side gives an empty result.
    """
    code = F.create_map(*[F.lit(x) for kv in ATTRIBUTES.items() for x in kv])
    both = [
        df.where("id is not null and token is not null").select(F.lit(side).alias("side"), "id", F.element_at(code, F.col("attr")).cast("tinyint").alias("attr"), F.xxhash64("token").alias("token"))
        for side, df in enumerate((left, right))
    ]
    tokens = cut(both[0].unionByName(both[1]).groupBy("side", "id", "attr", "token").agg(F.count(F.lit(1)).cast("int").alias("n")))
    counts = {0: 0, 1: 0} | {r["side"]: r["n"] for r in tokens.groupBy("side").agg(F.approx_count_distinct("id", 0.02).alias("n")).collect()}
    # a token that only one source has can link nothing; of titles and persons it still tells that there is one
    bridge = tokens.groupBy("token").agg(F.count_if(F.col("side") == 0).alias("nl"), F.count_if(F.col("side") == 1).alias("nr")).where("nl > 0 and nr > 0")
    bridged = cut(tokens.join(bridge.select("token", (F.col("nl") + F.col("nr")).cast("int").alias("df")), "token", "left").where((F.col("attr") != ATTRIBUTES["name"]) | F.col("df").isNotNull()))
    release(tokens)
    model = fit_vectors(bridged, counts)
    vectors = cut(record_vectors(bridged, model, sum(counts.values())))
    release(model)
    known = [bridged.where((F.col("side") == k) & F.col("df").isNotNull()).drop("side") for k in (0, 1)]
    infos = [left_info.groupBy("id").agg(F.max("year").alias("year"), F.max("volume").alias("volume")), right_info.groupBy("id").agg(F.max("year").alias("year"), F.max("volumes").alias("volumes"))]
    sides = [cut(with_sketches(vectors.where(F.col("side") == k)).join(infos[k], "id", "left")) for k in (0, 1)]
    release(vectors)
    # apart from the cosines, so the shuffle files of the tables are gone before vectors are shuffled
    pairs = cut(candidates(sides, counts[1], evidence_keys(*known, *sides)))
    release(bridged)
    scored = cut(rerank(pairs, *(side.drop("sketch", *_LISTS) for side in sides)))
    release(pairs, *sides)
    present = sum((F.col(c).isNotNull().cast("int") for c in list(ATTRIBUTES)[1:]), F.col("title").isNotNull().cast("int"))
    cosine = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in list(ATTRIBUTES)[1:]), F.coalesce("title", F.lit(0.0))) / present
    scored = scored.withColumn("cosine", cosine)
    weights = _calibrate(scored)
    logit = sum((F.lit(float(w)) * f for w, f in zip(weights, _features())), F.lit(float(weights[-1])))
    rated = scored.where("not other_volume").withColumn("confidence", 1 / (1 + F.exp(-logit)))
    best = top_per_group(rated, "left_id", [F.col("confidence").desc(), F.col("cosine").desc(), F.col("right_id")])
    return best.where(F.col("confidence") >= min_confidence).select("left_id", "right_id", "confidence", "cosine", *ATTRIBUTES, "gap")


def _calibrate(scored: DataFrame) -> np.ndarray:
    """Weights of the features, the constant last.

    Same are the pairs in which each side is the other's nearest, leads all others by
    ``LEAD`` and agrees with it in two attributes; the year of a like title stands in
    where persons and names are missing,
    and of two that name other persons nearly all names must agree. Different are the nearest that agree in one alone, as the same title makes no
    match, and those that another one of the left record leads by as much. The labels come
    from these orders, the curve from the values of all these pairs. A kind with more than
    ``FIT_PAIRS`` pairs weighs as much as so many.
    """
    agree = sum((F.coalesce(F.col(c) >= 0.6, F.lit(False)).cast("int") for c in ATTRIBUTES), F.coalesce(F.col("person").isNull() & F.col("name").isNull() & (F.col("title") >= 0.8) & (F.col("gap") <= YEAR_GAP), F.lit(False)).cast("int"))
    doubt = F.coalesce((F.col("person") < 0.25) & (F.coalesce("name", F.lit(0.0)) < 0.85), F.lit(False))
    scored = scored.withColumn("agree", F.when(doubt, 0).otherwise(agree))
    leads = scored.select("left_id", "right_id", "title", "person", "name", "gap", "cosine", "agree")
    for side in ("left_id", "right_id"):
        order = Window.partitionBy(side).orderBy(F.col("cosine").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        leads = leads.withColumns({f"top_{side}": F.first("cosine").over(order), f"next_{side}": F.nth_value("cosine", 2).over(order)})
        # what is far below any lead has no place in the order
        leads = leads.where(F.col(f"top_{side}") >= 2 * LEAD).withColumn(f"next_{side}", F.when(F.col(f"next_{side}") >= 2 * LEAD, F.col(f"next_{side}")))
    leads = leads.select("*", *[f.alias(f"f{i}") for i, f in enumerate(_features())])
    first = [(F.col("cosine") == F.col(f"top_{s}")) & (F.col("cosine") - F.coalesce(F.col(f"next_{s}"), F.lit(0.0)) >= LEAD) for s in ("left_id", "right_id")]
    same = F.when(first[0] & first[1], (F.col("agree") >= 2).cast("double")).when(F.col("top_left_id") - F.col("cosine") >= LEAD, 0.0)
    n_features = len(_features())

    def pack(batches):
        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            yield pa.RecordBatch.from_arrays([pa.array([rows.tobytes()], pa.binary())], names=["rows"])

    # read again for every step, so the rows lie packed
    known = cut(leads.select(same.alias("same"), *[f"f{i}" for i in range(n_features)]).where("same is not null").mapInArrow(pack, "rows binary"))
    beta = np.zeros(n_features + 1)
    for _ in range(30):

        def sums(batches, beta=beta):
            total = np.zeros((2, len(beta), len(beta) + 2))
            for batch in batches:
                for rows in batch.column(0).to_pylist():
                    rows = np.frombuffer(rows).reshape(-1, len(beta))
                    for kind in (0, 1):
                        x = rows[rows[:, 0] == kind]
                        x = np.column_stack([x[:, 1:], np.ones(len(x))])
                        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
                        total[kind, :, :-2] += x.T @ (x * (p * (1 - p))[:, None])
                        total[kind, :, -2] += x.T @ (kind - p)
                        total[kind, :, -1] += len(x)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        total = sum((np.frombuffer(r["sums"]).reshape(2, len(beta), -1) for r in known.mapInArrow(sums, "sums binary").collect()), np.zeros((2, len(beta), len(beta) + 2)))
        sizes = total[:, 0, -1]
        if not sizes.all():
            release(known)
            return np.array([6.0, 3.0, 5.0, -3.0, -2.0, 1.0, -1.0, -6.0])
        total = np.tensordot(np.minimum(1.0, FIT_PAIRS / sizes), total[:, :, :-1], 1)
        change = np.linalg.solve(total[:, :-1] + 1e-2 * np.eye(len(beta)), total[:, -1] - 1e-2 * beta)
        beta = beta + change
        if np.abs(change).max() < 1e-6:
            break
    release(known)
    return beta
