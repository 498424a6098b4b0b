"""The core's numbered problems against brute force, with the awkward inputs of each."""

import random
from collections import Counter

import numpy as np
import pytest

from quire.operators import matching, representatives, sampling, shared_spans, terms
from quire.operators.matching import match_records, walk_sequences, train_vectors
from pyspark.sql import functions as F


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# --- terms ---


def test_terms_count_occurrences_records_and_marks(spark):
    texts = [(1, "The cat, the CAT."), (2, "A cat"), (3, "dog's 2nd naïve été"), (4, None), (5, ""), (6, "123 --"), (7, "cat"), (8, "cat")]
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "id int, text string, term string")
    got = {r["term"]: (r["occurrences"], r["records"], r["mark"]) for r in terms.term_frequencies(df, run_pairs=3).collect()}
    assert got["cat"] == (5, 4, "common")
    assert got["the"] == (2, 1, "rare")
    assert got["naïve"] == (1, 1, "rare") and got["s"] == (1, 1, "rare") and got["nd"] == (1, 1, "rare")
    assert "123" not in got


def test_terms_of_nothing(spark):
    empty = spark.createDataFrame([], "id int, text string")
    assert terms.term_frequencies(empty).count() == 0


def test_term_runs_agree_with_counters():
    import numpy as np

    rng = random.Random(1)
    docs = [[rng.choice("abcdefg") for _ in range(rng.randint(1, 30))] for _ in range(50)]
    flat = [w for d in docs for w in d]
    words, occurrences, holders = terms.run_lengths(flat, np.repeat(np.arange(50), [len(d) for d in docs]))
    assert dict(zip(words.to_pylist(), occurrences.tolist())) == Counter(flat)
    assert dict(zip(words.to_pylist(), holders.tolist())) == Counter(w for d in docs for w in set(d))


def test_distinct_records_takes_repeated_rows_once(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (None, "b"), (2, None)], "k int, t string")
    assert rows(terms.distinct_records(df, "k", "t"), "id", "text") == [(1, "a"), (2, None)]


# --- shared spans ---


def brute_pairs(records, span):
    found = set()
    for i, (a, ga, ta) in enumerate(records):
        for b, gb, tb in records[i + 1 :]:
            other = ga is None or gb is None or ga != gb
            if a != b and other and ta and tb and any(ta[k : k + span] in tb for k in range(len(ta) - span + 1)):
                found.add((min(a, b), max(a, b)))
    return found


@pytest.mark.parametrize("seed", range(3))
def test_shared_pairs_agree_with_brute_force(spark, seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcd efgh") for _ in range(n))
    source = text(600)
    records = [(i, rng.choice([1, 2, 3, None]), text(rng.randint(0, 150)) + source[(s := rng.randint(0, 500)) : s + rng.choice([55, 59, 60, 61, 90])] + text(rng.randint(0, 60))) for i in range(40)]
    records += [(100, 1, None), (101, 2, ""), (102, 3, "x" * 300), (103, 4, "x" * 200), (104, 5, "ab" * 200), (105, 6, "ab" * 90), (106, 1, records[0][2]), (107, None, records[0][2])]
    df = spark.createDataFrame([(i, g, t, "clash") for i, g, t in records + records[:5]], "rid int, g int, body string, unit string")
    got = {tuple(r) for r in shared_spans.shared_pairs(df, "rid", "g", "body", 60).select("id_a", "id_b").collect()}
    assert got == brute_pairs(records, 60)


def test_a_short_sentence_in_many_texts_forms_no_square(spark, monkeypatch):
    rng = random.Random(9)
    filler = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    sentence, longer = filler(180), filler(230)
    data = [(i, i, filler(rng.randint(60, 120)) + (longer if i % 50 == 0 else sentence) + filler(rng.randint(60, 120))) for i in range(400)]
    data += [(1000 + i, 1000 + i, filler(30) + sentence[:170] + filler(40)) for i in range(60)]
    df = spark.createDataFrame(data, "rid int, g int, body string")
    formed = []
    compare = shared_spans.shared_intervals
    units = spark.createDataFrame([(r, f"g{g}", t) for r, g, t in data], "unit int, grp string, text string")
    real = shared_spans.cut

    def counted(table):
        out = real(table)
        formed.extend([out.count()] if out.columns == ["unit_a", "unit_b"] else [])
        return out

    monkeypatch.setattr(shared_spans, "cut", counted)
    found = {tuple(r) for r in shared_spans.shared_unit_pairs(units, 200).where("unit < other").select("unit", "other").distinct().collect()}
    monkeypatch.undo()
    by_id = {r: t for r, _, t in data}
    tens = [r for r, _, t in data if longer in t]
    assert {(a, b) for a in tens for b in tens if a < b} <= found
    assert all(compare(by_id[a], by_id[b], 200) for a, b in found)
    assert formed[0] <= 2 * len(found) + 50  # of the order of what is wanted, not 460 squared
    assert {tuple(r) for r in shared_spans.shared_pairs(df, "rid", "g", "body", 200).collect()} == found


def test_crowded_chunks_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(shared_spans, "CROWDED", 2)
    rng = random.Random(10)
    filler = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    parts = [filler(rng.randint(50, 90)) for _ in range(5)]
    data = [(i, i // 2, filler(rng.randint(0, 40)) + "".join(parts[rng.randrange(5)] for _ in range(rng.randint(1, 3))) + filler(rng.randint(0, 40))) for i in range(60)]
    df = spark.createDataFrame(data, "rid int, g int, body string")
    got = {tuple(r) for r in shared_spans.shared_pairs(df, "rid", "g", "body", 70).select("id_a", "id_b").collect()}
    want = {(a, b) for a, ga, x in data for b, gb, y in data if a < b and ga != gb and any(x[i : i + 70] in y for i in range(len(x) - 69))}
    assert got == want and len(want) > 50


def test_shared_share_counts_characters_once(spark):
    common = "".join(chr(97 + (i * i) % 26) for i in range(120))
    df = spark.createDataFrame([(1, 1, common + "tail one"), (2, 2, "head " + common), (3, 3, common[:80])], "rid int, g int, body string")
    got = {r["id"]: (r["shared_chars"], r["n_texts"]) for r in shared_spans.shared_share(df, "rid", "g", "body", 60).collect()}
    assert got[1] == (120, 2) and got[2] == (120, 2) and got[3] == (80, 2)


def test_every_shared_span_keeps_a_chunk():
    rng = random.Random(5)
    for _ in range(200):
        span = rng.choice([60, 100, 200])
        core = "".join(rng.choice("ab c") for _ in range(span))
        a = "".join(rng.choice("ab c") for _ in range(rng.randint(0, 90))) + core + "".join(rng.choice("ab c") for _ in range(rng.randint(0, 90)))
        b = "".join(rng.choice("ab c") for _ in range(rng.randint(0, 90))) + core
        owner, digest = shared_spans.chunk_digests([a, b], span)
        assert set(digest[owner == 0].tolist()) & set(digest[owner == 1].tolist())


# --- sampling ---


def test_sample_is_fixed_in_size_and_independent_of_delivery(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    whole = rows(sampling.permutation_sample(df, "k", 50, seed=3), "k", "position")
    assert len(whole) == 50 and sorted(p for _, p in whole) == list(range(1, 51))
    held = sampling.permutation_sample(df.where("k < 200"), "k", 50, seed=3)
    merged = sampling.merge_sample(held, df.where("k >= 150"), "k", 50, seed=3)
    assert rows(merged, "k") == sorted(((k,) for k, _ in whole), key=repr)


def test_every_record_has_the_same_chance(spark):
    df = spark.range(40).withColumnRenamed("id", "k")
    hits = Counter(k for s in range(60) for (k,) in rows(sampling.permutation_sample(df, "k", 10, seed=s), "k"))
    assert sum(hits.values()) == 600 and min(hits.values()) >= 4 and max(hits.values()) <= 30


def test_small_strata_come_whole_and_null_keys_are_left_out(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (None, "b")], "k int, s string")
    assert rows(sampling.permutation_sample(df, "k", 5, F.col("s")), "k") == [(1,), (2,), (3,)]
    assert sampling.permutation_sample(df.limit(0), "k", 5).count() == 0


# --- representatives ---


def test_top_per_group_breaks_ties_and_leaves_out_null_groups(spark):
    df = spark.createDataFrame([(1, 1, 5), (2, 1, 7), (3, 1, 7), (4, None, 9), (5, 2, None)], "id int, g int, v int")
    assert rows(representatives.top_per_group(df, "g", [F.col("v").desc_nulls_last(), F.col("id")]), "g", "id") == [(1, 2), (2, 5)]
    assert representatives.top_per_group(df.limit(0), "g", [F.col("id")]).count() == 0


def test_merge_fields_takes_each_field_from_its_best_record(spark):
    df = spark.createDataFrame([(1, 1, "short", "en", 1), (2, 1, "the longest", None, 2), (3, 1, None, "fr", 3), (4, 2, None, None, 1)], "id int, g int, text string, lang string, at int")
    got = representatives.merge_fields(df, "g", "id", {"text": [F.length("text").desc()], "lang": [F.col("at").desc()]})
    assert rows(got, "g", "n_records", "text", "text_id", "lang", "lang_id") == [(1, 3, "the longest", 2, "fr", 3), (2, 1, None, None, None, None)]


# --- matching ---


def _side(spark, records):
    return spark.createDataFrame([(i, a, t) for i, attrs in records for a, ts in attrs.items() for t in ts], "id long, attr string, token string")


def test_matching_needs_more_than_a_title(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    books = [(i, {"title": [word(), word()], "person": [word(), word()], "name": [word() for _ in range(6)]}) for i in range(60)]
    wiki = [(1000 + i, {"title": b["title"], "person": b["person"], "name": b["name"][:4] + [word()]}) for i, b in books[:30]]
    wiki += [(2000 + i, {"title": b["title"], "person": [word(), word()], "name": [word() for _ in range(4)]}) for i, b in books[30:40]]
    wiki += [(3000, {"title": ["nothing"], "person": [], "name": []})]
    info = lambda ids, col, kind: spark.createDataFrame([(i, 1990, None) for i in ids], f"id long, year int, {col} {kind}")
    got = match_records(_side(spark, wiki + wiki[:3]), _side(spark, books), info([w for w, _ in wiki], "volume", "string"), info([b for b, _ in books], "volumes", "array<string>"))
    pairs = {(r["left_id"], r["right_id"]) for r in got.collect()}
    assert pairs == {(1000 + i, i) for i in range(30)}


def test_matching_does_not_depend_on_the_tables(spark, monkeypatch):
    from quire.operators import matching

    monkeypatch.setattr(matching, "MAX_SIGN_BITS", -1)  # the tables lose every pair, as some do in a large input
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    books = [(i, {"title": [word(), word()], "person": [word()] if i % 3 else [], "name": [word() for _ in range(3)]}) for i in range(60)]
    wiki = [(1000 + i, {"title": b["title"] + ["extra"] * (i % 2), "person": b["person"], "name": b["name"][:2] if i < 20 else [word()]}) for i, b in books[:40]]
    info = lambda ids, shift, col, kind: spark.createDataFrame([(i, 1990 + shift, None) for i in ids], f"id long, year int, {col} {kind}")
    got = match_records(_side(spark, wiki), _side(spark, books), info([w for w, _ in wiki], 2, "volume", "string"), info([b for b, _ in books], 0, "volumes", "array<string>"), min_confidence=0.2)
    assert {(r["left_id"], r["right_id"]) for r in got.collect()} == {(1000 + i, i) for i in range(40)}


def test_matching_of_an_empty_side(spark):
    books = _side(spark, [(1, {"title": ["a"]})])
    info = spark.createDataFrame([], "id long, year int, volume string")
    infos = spark.createDataFrame([], "id long, year int, volumes array<string>")
    assert match_records(books.limit(0), books, info, infos).count() == 0


def test_training_brings_walked_neighbours_together():
    import numpy as np

    records = [[(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)]] * 40 + [[(0, 11, 1.0), (1, 12, 1.0), (2, 13, 1.0)]] * 40 + [[(0, 20 + i, 1.0), (1, 60 + i, 1.0)] for i in range(30)]
    v = train_vectors(walk_sequences(records, np.random.default_rng(0)))
    assert v.shape[1] == 64 and np.allclose(np.linalg.norm(v, axis=1), 1, atol=1e-3)


def test_best_records_without_the_optional_subpackage(spark, tmp_path, monkeypatch):
    from quire.plans import problems, registry

    monkeypatch.setattr(registry, "hooks", {})
    french = "La maison est dans la ville et les habitants qui sont des amis de la famille"
    data = [(1, 7, french, "fre", 1), (2, 7, "Short one", "eng", 2), (3, 7, None, "fr", 3), (4, 8, french, "fr", 1), (5, None, french, "fr", 1), (6, 9, None, None, 1), (7, 9, "", "en", 1), (1, 7, french, "fre", 1)]
    spark.createDataFrame(data, "book_id long, work_id long, description string, language_code string, updated_at int").write.parquet(f"{tmp_path}/goodreads_books.parquet")
    got = {tuple(r) for r in problems.p4_found(spark, str(tmp_path)).select("work_id", "description_book_id", "language_book_id").collect()}
    assert got == {(7, 1, 3), (9, 0, 0)}

def test_every_record_takes_part_in_the_training(spark):
    # 7,000 records a side, each pair with a token of its own and one of seven that many have
    rows = [(side, i, k, token, 1, df) for side in (0, 1) for i in range(7000) for k, token, df in ((2, 1000 + i, 2), (0, i % 7, 2000))]
    tokens = spark.createDataFrame(rows, "side int, id int, attr tinyint, token bigint, n int, df int")
    model = {r["token"]: np.frombuffer(r["vector"], np.int8) / 127 for r in matching.fit_vectors(tokens, {0: 7000, 1: 7000}).collect()}
    found = set(model)  # no walk may come by a token or two
    assert found <= {*range(7), *range(1000, 8000)} and len(found) > 0.99 * 7007


def test_walks_of_all_records_keep_to_the_graph(spark, monkeypatch):
    monkeypatch.setattr(matching, "MANY_HOLDERS", 20)
    rows = [(i % 2, i, k, token, 1, df) for i in range(100) for k, token, df in ((0, 5, 100), (2, 100 + i // 4, 4))]
    tokens = spark.createDataFrame(rows, "side int, id int, attr tinyint, token bigint, n int, df int")
    walks = [np.frombuffer(r["data"], np.int64).reshape(-1, 1 + matching.WALK_TOKENS) for r in matching.walk_all(tokens, 100, 3).collect()]
    walks = np.concatenate(walks)[:, 1:]
    assert len(walks) == 100 * matching.WALKS
    # a record has token 5 and one other, so no step leads from one of these to another
    assert all(a == b or 5 in (a, b) for w in walks.tolist() for a, b in zip(w, w[1:]))
    assert {t for w in walks.tolist() for t in w} == {5, *range(100, 125)}


def test_training_takes_all_pairs_of_a_walk_at_once(monkeypatch):
    monkeypatch.setattr(matching, "STEP_WALKS", 1)
    walks = np.random.default_rng(4).integers(0, 12, (30, matching.WALK_TOKENS))
    start = matching._signs(np.arange(12))
    got = matching.skip_grams(walks, start, np.random.default_rng(1))
    rng, vectors, context = np.random.default_rng(1), start.astype(float), np.zeros(start.shape)
    seen, counts = np.unique(walks, return_counts=True)
    noise = np.cumsum(counts**0.75)
    for walk in walks[rng.permutation(len(walks))]:
        others = seen[np.searchsorted(noise, rng.random((1, matching.NOISE)) * noise[-1])][0]
        v, c = vectors.copy(), context.copy()
        for i, a in enumerate(walk):
            for j in range(max(0, i - matching.WINDOW), min(len(walk), i + matching.WINDOW + 1)):
                if walk[j] == a:
                    continue
                for b, wanted, weight in [(walk[j], 1, 1), *((x, 0, matching.NEGATIVES / matching.NOISE) for x in others)]:
                    step = matching.RATE * weight * (wanted - 1 / (1 + np.exp(-v[a] @ c[b])))
                    vectors[a] += step * c[b]
                    context[b] += step * v[a]
    assert np.abs(got - start).max() > 1e-3 and np.allclose(got, vectors, atol=1e-4)


def test_rows_are_added_where_places_come_again():
    at, rows = np.random.default_rng(4).integers(0, 12, 300) ** 2, np.random.default_rng(5).random((300, 3))
    table, wanted = np.zeros((122, 3)), np.zeros((122, 3))
    np.add.at(wanted, at, rows)
    matching._add_rows(table, at, rows)
    assert np.allclose(table, wanted)


def test_records_list_their_tokens_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(0, 1, 0, t, 1, df) for t, df in ((11, 5), (12, 2), (13, None), (14, 3), (15, 4))] + [(0, 1, 1, 20, 1, 2), (0, 2, 2, 30, 1, 2), (1, 3, 0, 12, 1, 2), (1, 3, 1, 21, 1, None)]
        tokens = spark.createDataFrame(rows, "side int, id int, attr tinyint, token bigint, n int, df int")
        model = spark.createDataFrame([(12, bytes([1] * matching.DIMENSIONS))], "token bigint, vector binary")
        got = {(r["side"], r["id"]): (r["titles"], r["persons"], r["nt"], r["np"]) for r in matching.record_vectors(tokens, model, 3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(0, 1): ([12, 14, 15, 11], [20], 5, 1), (0, 2): ([], [], 0, 0), (1, 3): ([12], [], 1, 1)}


def test_walks_move_alone(spark, monkeypatch):
    rows = [(i % 2, i, k, token, 1, df) for i in range(400) for k, token, df in ((0, i % 9, 45), (2, 100 + i // 4, 4))]
    tokens = spark.createDataFrame(rows, "side int, id int, attr tinyint, token bigint, n int, df int")
    plans, cut = [], matching.cut
    monkeypatch.setattr(matching, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    matching.walk_all(tokens, 400, 3).count()
    steps = [p for p in plans if "CoGroupsInArrow" in p]
    assert len(steps) == matching.WALK_TOKENS - 1 and all(p.count("Exchange") == 1 for p in steps)
