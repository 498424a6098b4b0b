"""Ways of working that larger inputs ask for give the same rows."""

import random
from collections import Counter

from pyspark.sql import functions as F

from quire.operators import bounding, graph
from quire.plans import registry

WEIGHTS = {"stunning": 3.1, "story": 2.9, "beautiful": 3.0, "tale": 2.5, "bold": 2.4, "grim": -0.9, "epic": 2.6}


def test_dense_rows_are_those_of_the_map_column(spark):
    texts = ["A stunning, beautiful and bold story.", "A stunnings storys tales boldly told novel.", "A stunning story of grim tales, a novel.", "A novel.", "", None, "How a stunning bold beautiful story book when told ends.", "Bold tales, epics: an EPIC novel.", "stunning beautiful book story"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, s string")
    weights = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    flagged = bounding.flag_rows(rows, "s", None, weights).where(F.array_contains("rules", "register_dense"))
    score = bounding.register_score(F.col("s"), weights)
    want = sorted(tuple(r) for r in flagged.select("k", score["mean"], score["n"]).collect())
    assert want and sorted(tuple(r) for r in bounding.dense_rows(rows, "s", WEIGHTS).select("k", "mean", "n").collect()) == want


def test_runs_of_characters_are_joined_without_the_driver(spark):
    weights = registry.queries()["char_ngram_tfidf"](spark, "/root/testdata/sf0.001")
    assert weights.collect()
    plan = weights._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def _partition(edges, n, part, gamma, total):
    degree = [0.0] * n
    inner = 0.0
    for a, b, w in edges:
        degree[a] += w
        degree[b] += w
        inner += w * (part[a] == part[b])
    sums = {}
    for v, p in enumerate(part):
        sums[p] = sums.get(p, 0.0) + degree[v]
    return 2 * inner / total - gamma * sum(x * x for x in sums.values()) / total**2


def test_communities_of_texts_are_as_good_as_those_of_listed_pairs(monkeypatch):
    for seed in range(6):
        rng = random.Random(seed)
        texts = [[v for v in range(g * 12, g * 12 + 12) if rng.random() < 0.4] for g in range(6) for _ in range(5)] + [rng.sample(range(72), 3) for _ in range(4)]
        pairs = Counter((a, b) for t in texts for a in t for b in t if a < b)
        edges, docs = [(a, b, float(w)) for (a, b), w in sorted(pairs.items())], [{d: 1.0 for d, t in enumerate(texts) if v in t} for v in range(72)]
        sizes, total = [float(len(t)) for t in texts], 2.0 * sum(pairs.values())
        listed = _partition(edges, 72, graph.Leiden(edges, 72, 1.0, 42, total).run(), 1.0, total)
        for large in (2, 1000):
            monkeypatch.setattr(graph.CliqueLeiden, "LARGE", large)
            part = graph.CliqueLeiden([x for x in docs], sizes, 1.0, random.Random(42), total).run()
            assert _partition(edges, 72, part, 1.0, total) > listed - 0.01


def test_a_text_of_many_members_needs_no_list_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(graph, "MAX_CLUSTER_EDGES", 1000)  # 300 members are 44,850 pairs
    docs = spark.createDataFrame([(7, k) for k in range(300)] + [(-1, 1000), (-1, 1001), (-1, 1002), (-2, 5000)], "doc bigint, key bigint")
    got = {r["node"]: (r["grp"], r["size"]) for r in graph.leiden_of_texts(docs, gamma=1.0).collect()}
    assert got == {**{k: (0, 300) for k in range(300)}, **{k: (1, 3) for k in (1000, 1001, 1002)}}
    assert {r["node"]: r["degree"] for r in graph.shared_degree(docs).collect()} == {**{k: 299 for k in range(300)}, **{k: 2 for k in (1000, 1001, 1002)}}
