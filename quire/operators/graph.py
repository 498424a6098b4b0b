"""Weighted undirected graphs as edge tables ``a, b, weight`` with ``a < b``."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, release

#: A connected component is clustered in one task only up to this many edges.
MAX_CLUSTER_EDGES = 20_000_000


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight").unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"), "weight"))


def weighted_degree(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("node").agg(F.sum("weight").alias("degree"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges between the given nodes."""
    return edges.join(nodes.select(F.col("node").alias("a")), "a", "left_semi").join(nodes.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b", "weight")


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node that can be reached.

    Labels spread to neighbours and then jump to their own label's label, so long chains
    halve in every round; each round is written to the shared folder.
    """
    sym = cut(both_ways(edges).select("node", "other").distinct())
    labels = cut(sym.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("component")))
    while True:
        near = sym.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        spread = labels.join(near, "node").select("node", F.least("component", "near").alias("component"))
        jump = spread.select(F.col("node").alias("component"), F.col("component").alias("further"))
        fresh = cut(spread.join(jump, "component", "left").select("node", F.coalesce("further", "component").alias("component")))
        if fresh.join(labels.withColumnRenamed("component", "old"), "node").where("component <> old").isEmpty():
            release(sym, labels)
            return fresh
        release(labels)
        labels = fresh


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 30) -> DataFrame:
    """``node, rank`` of an undirected weighted graph; ranks sum to one."""
    sym = cut(both_ways(edges))
    out = sym.groupBy("node").agg(F.sum("weight").alias("total"))
    steps = cut(sym.join(out, "node").select("node", "other", (F.col("weight") / F.col("total")).alias("p")))
    n = out.count()
    ranks = out.select("node", F.lit(1.0 / max(n, 1)).alias("rank"))
    for i in range(rounds):
        flow = steps.join(ranks, "node").groupBy(F.col("other").alias("node")).agg(F.sum(F.col("rank") * F.col("p")).alias("r"))
        ranks = flow.select("node", (F.lit((1 - damping) / max(n, 1)) + damping * F.col("r")).alias("rank"))
        if i % 5 == 4:
            ranks = cut(ranks)
    return ranks


def modularity(edges: DataFrame, groups: DataFrame, gamma: float = 1.0) -> DataFrame:
    """One row ``modularity`` of a partition ``node, grp``."""
    g = edges.join(groups.select(F.col("node").alias("a"), F.col("grp").alias("ga")), "a").join(groups.select(F.col("node").alias("b"), F.col("grp").alias("gb")), "b")
    inner = g.agg(F.sum(F.when(F.col("ga") == F.col("gb"), F.col("weight")).otherwise(0)).alias("inner"), F.sum("weight").alias("m"))
    degree = weighted_degree(edges).join(groups, "node").groupBy("grp").agg(F.sum("degree").alias("d")).agg(F.sum(F.col("d") * F.col("d")).alias("d2"))
    return inner.crossJoin(F.broadcast(degree)).select((F.col("inner") / F.col("m") - gamma * F.col("d2") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


class Leiden:
    """Leiden clustering for modularity with a resolution (Traag, Waltman and van Eck 2019)."""

    def __init__(self, edges: list[tuple[int, int, float]], n: int, gamma: float, seed: int, total: float | None = None):
        self.gamma, self.rng = gamma, random.Random(seed)
        self.near: list[dict[int, float]] = [defaultdict(float) for _ in range(n)]
        self.own = [0.0] * n
        for a, b, w in edges:
            if a == b:
                self.own[a] += w
            else:
                self.near[a][b] += w
                self.near[b][a] += w
        self.degree = [sum(x.values()) + 2 * s for x, s in zip(self.near, self.own)]
        self.total = total or sum(self.degree) or 1.0

    def _move(self, part: list[int]) -> bool:
        """Move nodes to the neighbouring part with the largest gain until none gains."""
        weight: dict[int, float] = defaultdict(float)
        for v, p in enumerate(part):
            weight[p] += self.degree[v]
        queue = list(range(len(part)))
        self.rng.shuffle(queue)
        waiting, moved = set(queue), False
        fresh = max(part, default=0) + 1
        while queue:
            nxt = []
            for v in queue:
                waiting.discard(v)
                old = part[v]
                weight[old] -= self.degree[v]
                links: dict[int, float] = defaultdict(float)
                for u, w in self.near[v].items():
                    links[part[u]] += w
                cost = self.gamma * self.degree[v] / self.total
                best, gain = old, links.get(old, 0.0) - cost * weight[old]
                for p, w in sorted(links.items()):
                    g = w - cost * weight[p]
                    if g > gain + 1e-12:
                        best, gain = p, g
                if gain < -1e-12:
                    best, fresh = fresh, fresh + 1
                weight[best] += self.degree[v]
                if best != old:
                    part[v], moved = best, True
                    for u in self.near[v]:
                        if part[u] != best and u not in waiting:
                            waiting.add(u)
                            nxt.append(u)
            queue = nxt
        return moved

    def _refine(self, part: list[int]) -> list[int]:
        """Split every part into well connected pieces by merging single nodes inside it."""
        piece = list(range(len(part)))
        size, alone = list(self.degree), [True] * len(part)
        order = list(range(len(part)))
        self.rng.shuffle(order)
        for v in order:
            if not alone[v]:
                continue
            links: dict[int, float] = defaultdict(float)
            for u, w in self.near[v].items():
                if part[u] == part[v]:
                    links[piece[u]] += w
            links.pop(piece[v], None)
            gains = {p: w - self.gamma * self.degree[v] * size[p] / self.total for p, w in links.items()}
            good = sorted(p for p, g in gains.items() if g > 0)
            if good:
                best = max(good, key=lambda p: (gains[p], -p))
                size[best] += self.degree[v]
                size[piece[v]] -= self.degree[v]
                alone[v] = alone[best] = False
                piece[v] = best
        return piece

    def run(self) -> list[int]:
        graph, where = self, list(range(len(self.near)))
        part = list(range(len(self.near)))
        while True:
            graph._move(part)
            if len(set(part)) == len(part):
                break
            piece = graph._refine(part)
            names = {p: i for i, p in enumerate(sorted(set(piece)))}
            node = [names[p] for p in piece]
            upper = [0] * len(names)
            for v, p in enumerate(part):
                upper[node[v]] = p
            edges: dict[tuple[int, int], float] = defaultdict(float)
            for v, near in enumerate(graph.near):
                for u, w in near.items():
                    if v < u:
                        a, b = sorted((node[v], node[u]))
                        edges[a, b] += w
                edges[node[v], node[v]] += graph.own[v]
            where = [node[x] for x in where]
            if len(names) == len(part):
                part = upper
                break
            nxt = Leiden([(a, b, w) for (a, b), w in edges.items()], len(names), graph.gamma, 0, graph.total)
            nxt.rng = graph.rng
            graph, part = nxt, upper
        return [part[x] for x in where]


def leiden(edges: DataFrame, gamma: float = 8.0, seed: int = 42) -> DataFrame:
    """``node, grp, size``: connected communities numbered by size, then smallest node.

    No community crosses a connected component, so each component is clustered in a task of
    its own, against the weight of the whole graph. A component beyond the bound must be cut
    by a weight threshold first.
    """
    comp = connected_components(edges).select(F.col("node").alias("a"), "component")
    placed = cut(edges.select("a", "b", "weight").join(comp, "a"))
    size = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).agg(F.max("n").alias("n"), F.sum("w").alias("w")).first()
    if (size["n"] or 0) > MAX_CLUSTER_EDGES:
        raise ValueError(f"a component has {size['n']} edges; at most {MAX_CLUSTER_EDGES} are clustered in one task")
    kind, total = edges.schema["a"].dataType.simpleString(), 2.0 * float(size["w"] or 0.0)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted(set(pdf["a"]) | set(pdf["b"]))
        index = {x: i for i, x in enumerate(nodes)}
        rows = sorted((index[a], index[b], float(w)) for a, b, w in zip(pdf["a"], pdf["b"], pdf["weight"]))
        part = Leiden(rows, len(nodes), gamma, seed, total).run()
        members = defaultdict(list)
        for x, p in zip(nodes, part):
            members[p].append(x)
        return pd.DataFrame([(x, m[0], len(m)) for m in members.values() for x in m], columns=["node", "first", "size"])

    found = cut(placed.groupBy("component").applyInPandas(run, f"node {kind}, first {kind}, size int"))
    return found.join(numbered(found.where("node = first"), [F.desc("size"), F.col("first")], "grp").select("first", "grp"), "first").select("node", F.col("grp").cast("int").alias("grp"), "size")


class CliqueLeiden:
    """:class:`Leiden` for ties that are common texts: all members of a text are tied by it, and no pair is listed.

    A node has its share in each text; what ties it to a part is its shares times those of
    the part. So memory follows the members of texts and not their pairs. Shares in texts
    of ``LARGE`` members and more are added up as arrays.
    """

    LARGE = 256

    def __init__(self, docs: list[dict[int, float]], sizes: list[float], gamma: float, rng: random.Random, total: float):
        self.docs, self.sizes, self.gamma, self.rng, self.total = docs, sizes, gamma, rng, total
        members = defaultdict(list)
        for v, own in enumerate(docs):
            for d in own:
                members[d].append(v)
        self.members = {d: np.array(m) for d, m in members.items()}
        self.large = {d for d, m in members.items() if len(m) >= self.LARGE}
        self.degree = [sum(c * (sizes[d] - 1) for d, c in own.items()) for own in docs]

    def _shares(self, part: list[int], room: int) -> dict:
        shares = {d: np.zeros(room) if d in self.large else defaultdict(float) for d in self.members}
        for v, own in enumerate(self.docs):
            for d, c in own.items():
                shares[d][part[v]] += c
        return shares

    def _links(self, v: int, own: int, shares: dict) -> tuple[np.ndarray, np.ndarray]:
        """Parts that a node is tied to, in order, and the ties, without those to itself."""
        few: dict[int, float] = defaultdict(float)
        many, loops = None, 0.0
        for d, c in self.docs[v].items():
            loops += c * c
            if d in self.large:
                many = shares[d] * c if many is None else many + shares[d] * c
            else:
                for p, x in shares[d].items():
                    if x:
                        few[p] += c * x
        if many is None:
            few[own] -= loops
            at = np.array(sorted(p for p, x in few.items() if x > 0), dtype=np.int64)
            return at, np.array([few[p] for p in at.tolist()])
        for p, x in few.items():
            many[p] += x
        many[own] -= loops
        at = np.flatnonzero(many > 0)
        return at, many[at]

    def _move(self, part: list[int]) -> None:
        n = len(part)
        weight, count = np.zeros(n), np.zeros(n, np.int64)
        for v, p in enumerate(part):
            weight[p] += self.degree[v]
            count[p] += 1
        empty = [p for p in range(n) if not count[p]]
        shares, where, waiting = self._shares(part, n), np.array(part), np.ones(n, bool)
        queue = list(range(n))
        self.rng.shuffle(queue)
        while queue:
            nxt = []
            for v in queue:
                waiting[v] = False
                old = int(where[v])
                weight[old] -= self.degree[v]
                at, ties = self._links(v, old, shares)
                cost = self.gamma * self.degree[v] / self.total
                gains = ties - cost * weight[at]
                here = np.searchsorted(at, old)
                best, gain = old, float(gains[here]) if here < len(at) and at[here] == old else -cost * float(weight[old])
                if len(at) and gains.max() > gain + 1e-12:
                    best, gain = int(at[gains.argmax()]), float(gains.max())
                if gain < -1e-12 and count[old] > 1 and empty:
                    best = empty.pop()
                weight[best] += self.degree[v]
                if best == old:
                    continue
                count[old] -= 1
                count[best] += 1
                if not count[old]:
                    empty.append(old)
                where[v] = best
                for d, c in self.docs[v].items():
                    shares[d][old] -= c
                    shares[d][best] += c
                    if d not in self.large and not shares[d][old]:
                        del shares[d][old]
                near = np.unique(np.concatenate([self.members[d] for d in self.docs[v]]))
                near = near[(where[near] != best) & ~waiting[near]]
                near = near[near != v]
                waiting[near] = True
                nxt += near.tolist()
            queue = nxt
        part[:] = where.tolist()

    def _refine(self, part: list[int]) -> list[int]:
        n = len(part)
        piece, size, alone = list(range(n)), np.array(self.degree, dtype=float), [True] * n
        inside, shares = np.array(part), self._shares(piece, n)  # a piece has the number of one of its nodes, so its part
        order = list(range(n))
        self.rng.shuffle(order)
        for v in order:
            if not alone[v]:
                continue
            at, ties = self._links(v, v, shares)
            keep = (inside[at] == part[v]) & (at != v)
            at, ties = at[keep], ties[keep]
            gains = ties - self.gamma * self.degree[v] * size[at] / self.total
            if len(at) and gains.max() > 0:
                best = int(at[gains.argmax()])
                size[best] += self.degree[v]
                size[v] -= self.degree[v]
                alone[v] = alone[best] = False
                piece[v] = best
                for d, c in self.docs[v].items():
                    shares[d][v] -= c
                    shares[d][best] += c
                    if d not in self.large and not shares[d][v]:
                        del shares[d][v]
        return piece

    def run(self) -> list[int]:
        graph, where = self, list(range(len(self.docs)))
        part = list(where)
        while True:
            graph._move(part)
            if len(set(part)) == len(part):
                break
            piece = graph._refine(part)
            names = {p: i for i, p in enumerate(sorted(set(piece)))}
            if len(names) == len(part):
                break
            docs: list[dict[int, float]] = [defaultdict(float) for _ in names]
            upper = [0] * len(names)
            for v, own in enumerate(graph.docs):
                upper[names[piece[v]]] = part[v]
                for d, c in own.items():
                    docs[names[piece[v]]][d] += c
            first = {p: i for i, p in reversed(list(enumerate(upper)))}
            where, part = [names[piece[x]] for x in where], [first[p] for p in upper]
            graph = CliqueLeiden(docs, graph.sizes, graph.gamma, graph.rng, graph.total)
        return [part[x] for x in where]


def shared(docs: DataFrame) -> DataFrame:
    """``doc, key, n``: the distinct members of texts that have two or more, with their number."""
    one = docs.select("doc", "key").distinct()
    return one.join(one.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n >= 2"), "doc")


def shared_degree(docs: DataFrame) -> DataFrame:
    """:func:`weighted_degree` of the ties between all members of a text, without listing them."""
    return shared(docs).groupBy(F.col("key").alias("node")).agg(F.sum(F.col("n") - 1).alias("degree"))


def leiden_of_texts(docs: DataFrame, gamma: float = 8.0, seed: int = 42) -> DataFrame:
    """:func:`leiden` of the ties between all members ``key`` of each ``doc``, whole numbers both.

    The pairs of a text grow with the square of its members, so no pair is listed and no
    component is too large for a bound on edges.
    """
    held = cut(shared(docs))
    kind, total = held.schema["key"].dataType.simpleString(), float(held.select("doc", "n").distinct().agg(F.sum(F.col("n") * (F.col("n") - 1)).cast("double")).first()[0] or 0.0) or 1.0
    # a text and a member have numbers of their own, of other parity
    comp = connected_components(held.select((F.col("key") * 2).alias("a"), (F.col("doc") * 2 + 1).alias("b"), F.lit(1).alias("weight")))
    placed = held.join(comp.select((F.col("node")).alias("_c"), "component"), F.col("key") * 2 == F.col("_c")).select("component", "doc", "key")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, at = np.unique(pdf["key"].to_numpy(), return_inverse=True)
        texts, of = np.unique(pdf["doc"].to_numpy(), return_inverse=True)
        own: list[dict[int, float]] = [{} for _ in nodes]
        for v, d in zip(at.tolist(), of.tolist()):
            own[v][d] = 1.0
        part = CliqueLeiden(own, np.bincount(of).astype(float).tolist(), gamma, random.Random(seed), total).run()
        members = defaultdict(list)
        for x, p in zip(nodes.tolist(), part):
            members[p].append(x)
        return pd.DataFrame([(x, m[0], len(m)) for m in members.values() for x in m], columns=["node", "first", "size"])

    found = cut(placed.groupBy("component").applyInPandas(run, f"node {kind}, first {kind}, size int"))
    release(held)
    return found.join(numbered(found.where("node = first"), [F.desc("size"), F.col("first")], "grp").select("first", "grp"), "first").select("node", F.col("grp").cast("int").alias("grp"), "size")


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """Rows with their number from 0 in ``order``: each task numbers a range after those before it."""
    placed = cut(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    before = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = before.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return placed.withColumn("_r", inside).join(before, "_p").withColumn(name, F.col("_before") + F.col("_r") - 1).drop("_p", "_before", "_r")


def group_traffic(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """``ga, gb, weight, normalised``: ties between groups, by the root of the sizes' product."""
    g = groups.select("node", "grp")
    sizes = g.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    joined = edges.join(g.select(F.col("node").alias("a"), F.col("grp").alias("x")), "a").join(g.select(F.col("node").alias("b"), F.col("grp").alias("y")), "b").where("x <> y")
    sums = joined.groupBy(F.least("x", "y").alias("ga"), F.greatest("x", "y").alias("gb")).agg(F.sum("weight").alias("weight"))
    return sums.join(sizes.select(F.col("grp").alias("ga"), F.col("n").alias("na")), "ga").join(sizes.select(F.col("grp").alias("gb"), F.col("n").alias("nb")), "gb").select("ga", "gb", "weight", (F.col("weight") / F.sqrt(F.col("na") * F.col("nb"))).alias("normalised"))


def cooccurrence(tokens: DataFrame, doc_col: str, pos_col: str, word_col: str, window: int = 4) -> DataFrame:
    """``a, b, weight``: in how many windows of ``window`` tokens two words stand together.

    Positions count from 0. Windows that hold both are counted in closed form from the two
    positions and the length, so each pair of near positions is formed once.
    """
    reach = window - 1
    length = tokens.groupBy(doc_col).agg((F.max(pos_col) + 1).alias("_len"))
    left = tokens.select(doc_col, F.col(pos_col).alias("p"), F.col(word_col).alias("x"), F.explode(F.sequence(F.col(pos_col) + 1, F.col(pos_col) + reach)).alias("q"))
    right = tokens.select(doc_col, F.col(pos_col).alias("q"), F.col(word_col).alias("y"))
    near = left.join(right, [doc_col, "q"]).where("x <> y").join(length, doc_col)
    starts = F.greatest(F.lit(0), F.least(F.col("p"), F.col("_len") - window) - F.greatest(F.lit(0), F.col("q") - reach) + 1)
    return near.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum(starts).alias("weight")).where("weight > 0")


def rank_in_group(members: DataFrame, order: list) -> DataFrame:
    return members.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(*order)))
