"""Neighbour graphs of groups: components, connectivity and minimum spanning trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import written

# Numbers of neighbours tried, and what counts as stable, tiny, a tail or a jump.
LADDER = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)
STABLE_WITHIN = 0.03
EDGES = 1 << 18  # Edges that a forest goes through at a time.
TINY_SIDE, TINY_SHARE, TAIL_SHARE, TAIL_MOST, JUMP = 10, 0.005, 0.8, 2, 1.8


def _local_components(both: DataFrame) -> DataFrame:
    """``connected_components`` of few edges, given both ways, in one task."""
    kind = dict(both.dtypes)["a"]

    def run(t: pa.Table) -> pa.Table:
        ends = np.concatenate([t["a"].to_numpy(), t["b"].to_numpy()])
        ids, at = np.unique(ends, return_inverse=True)
        u, v = at[: t.num_rows], at[t.num_rows :]
        label = np.arange(len(ids))
        while True:
            new = label.copy()
            np.minimum.at(new, label[u], label[v])  # a label falls to the least that its nodes meet
            new = new[label]
            while not np.array_equal(new, new[new]):
                new = new[new]
            if np.array_equal(new, label):
                break
            label = new
        return pa.table({"node": pa.array(ids, t["a"].type), "component": pa.array(ids[label], t["a"].type)})

    return both.groupBy(F.lit(0).alias("_all")).applyInArrow(lambda t: run(t), f"node {kind}, component {kind}")


def connected_components(edges: DataFrame, max_rounds: int = 60, finish: int = 0) -> DataFrame:
    """(node, component) for every endpoint of ``edges(a, b)``, the component being its smallest node.

    Labels fall to the smallest among neighbours, members and the label's own label in each round,
    so rounds grow with the logarithm of the longest chain. Only minima cross the shuffle. Up to
    ``finish`` edges of integers are done in one task.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct()
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    if finish and both.count() <= 2 * finish:
        return _local_components(both)
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")))
    for _ in range(max_rounds):
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        hooked = labels.join(seen, "node").withColumn("new", F.least("label", "seen"))
        roots = hooked.groupBy("label").agg(F.min("new").alias("low"))
        moved = hooked.join(roots, "label").select("node", F.col("label").alias("old"), F.least("new", "low").alias("label"))
        moved = written(moved.join(roots.withColumnRenamed("low", "further"), "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        labels = moved.select("node", "label")
        if not moved.where("label < old").limit(1).count():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components not settled after {max_rounds} rounds")


def activation_ranks(neighbours: DataFrame, group: str) -> DataFrame:
    """(group, u, v, rank, dist) with u < v: the undirected edges of a neighbour table and the smaller rank of either direction."""
    ends = neighbours.select(group, F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), "rank", "dist")
    return ends.groupBy(group, "u", "v").agg(F.min("rank").alias("rank"), F.min("dist").alias("dist"))


def core_items(isolation: DataFrame, group: str) -> DataFrame:
    """Items whose isolation is below the group's mean plus two population deviations; of a constant group none."""
    limits = isolation.groupBy(group).agg((F.avg("isolation") + 2 * F.stddev_pop("isolation")).alias("limit"))
    return isolation.join(limits, group).where("isolation < limit").drop("limit")


@dataclass
class Forest:
    """Union-find with the sizes of its trees."""

    n: int
    parent: np.ndarray = field(init=False)
    size: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.parent, self.size = np.arange(self.n), np.ones(self.n, np.int64)

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return int(x)

    def join(self, a: int, b: int) -> int:
        """Size of the smaller side, 0 if they were together."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return 0
        if self.size[a] < self.size[b]:
            a, b = b, a
        side = int(self.size[b])
        self.parent[b] = a
        self.size[a] += side
        return side

    def labels(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(self.n)], np.int64)


@dataclass
class SpanningTree:
    weights: list[float]
    components: int
    last_side: int
    labels: np.ndarray

    @property
    def largest(self) -> float:
        return self.weights[-1] if self.weights else 0.0

    @property
    def second(self) -> float:
        return self.weights[-2] if len(self.weights) > 1 else 0.0


def forest_edges(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Places of the edges, given in order of weight, that a spanning forest of n nodes keeps: ``EDGES`` at a time, each run between the trees of those before."""
    component, kept = np.arange(n), []
    for i in range(0, len(u), EDGES):
        chosen, component = _forest_between(component, u[i : i + EDGES], v[i : i + EDGES])
        kept.append(chosen + i)
        if (component == component[0]).all():
            break
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def _forest_between(component: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the edges that join components, the components they leave): every component takes its first edge out, round by round."""
    n, places, kept = len(component), np.arange(len(u)), []
    while len(places):
        a, b = component[u[places]], component[v[places]]
        apart = a != b
        places, a, b = places[apart], a[apart], b[apart]
        if not len(places):
            break
        first = np.full(n, len(u))
        for side in (a, b):  # of writes to one component the last counts, which is the earliest edge
            own = np.full(n, len(u))
            own[side[::-1]] = places[::-1]
            np.minimum(first, own, out=first)
        chosen = np.unique(first[first < len(u)])
        kept.append(chosen)
        of = np.flatnonzero(first < len(u))
        x, y = component[u[first[of]]], component[v[first[of]]]
        to = np.arange(n)
        to[of] = np.where(x == of, y, x)
        mutual = to[to] == np.arange(n)
        to = np.where(mutual & (np.arange(n) < to), np.arange(n), to)
        while not np.array_equal(to, to[to]):
            to = to[to]
        component = to[component]
    return np.sort(np.concatenate(kept)) if kept else np.zeros(0, np.int64), component


def spanning_tree(n: int, u: np.ndarray, v: np.ndarray, dist: np.ndarray) -> SpanningTree:
    """Minimum spanning forest: edges in order of distance, each kept that joins two trees."""
    forest, weights, side = Forest(n), [], 0
    order = np.lexsort((v, u, dist))
    for e in order[forest_edges(n, u[order], v[order])]:
        side = forest.join(int(u[e]), int(v[e]))
        weights.append(float(dist[e]))
    return SpanningTree(weights, n - len(weights), side, forest.labels())


def connectivity(n: int, u: np.ndarray, v: np.ndarray, rank: np.ndarray) -> int:
    """Smallest number of neighbours with which the graph hangs together, -1 if none does: the bottleneck of a spanning tree by rank."""
    if n < 2:
        return -1
    tree = spanning_tree(n, u, v, rank)
    return int(tree.largest) if tree.components == 1 else -1


def stable_neighbours(trees: dict[int, SpanningTree]) -> int:
    """Smallest rung whose longest tree edge is within 3% of the highest rung's."""
    rungs = sorted(trees)
    reference = trees[rungs[-1]].largest
    return next(k for k in rungs if reference <= 0 or (trees[k].largest - reference) / reference <= STABLE_WITHIN)


def pathological(tree: SpanningTree, n: int) -> bool:
    """Whether the last merge is a lone long edge to a tiny side."""
    if tree.largest <= 0 or n < 2:
        return False
    tail = sum(w >= TAIL_SHARE * tree.largest for w in tree.weights)
    lone = tail <= TAIL_MOST or (tree.second > 1e-9 and tree.largest / tree.second >= JUMP)
    return tree.last_side <= TINY_SIDE and tree.last_side / n <= TINY_SHARE and lone


def graph_statistics(n: int, u: np.ndarray, v: np.ndarray, rank: np.ndarray, dist: np.ndarray, k_cap: int) -> dict:
    near = dist < 1.0
    k_conn = connectivity(n, u, v, rank)
    start = k_conn if k_conn > 0 else k_cap
    rungs = rungs_between(start, k_cap)
    trees = {k: spanning_tree(n, u[near & (rank <= k)], v[near & (rank <= k)], dist[near & (rank <= k)]) for k in rungs}
    k_stable = stable_neighbours(trees)
    tree = trees[k_stable]
    return {
        "n_main": n, "k_conn": k_conn, "k_stable": k_stable, "k_cap": k_cap, "mst_max_edge": tree.largest, "mst_w2": tree.second, "bridge_min_side": tree.last_side,
        "components": tree.components, "low_pair_count": n < 20, "disconnected": tree.components > 1, "pathological_bridge": pathological(tree, n), "labels": tree.labels,
    }


STATISTICS = "n_main long, k_conn int, k_stable int, k_cap int, mst_max_edge double, mst_w2 double, bridge_min_side int, components int, low_pair_count boolean, disconnected boolean, pathological_bridge boolean"


ONE_TASK_ITEMS = 100_000  # Items of a group whose graph one task takes; those of larger ones are shared out.


def mst_statistics(neighbours: DataFrame, core: DataFrame, group: str, id: str, k_cap: int) -> tuple[DataFrame, DataFrame]:
    """(statistics per group, component per core item) of the neighbour graphs of the core items.

    The edges of a group of up to ``ONE_TASK_ITEMS`` items meet in one task: k_cap rows per item.
    Larger groups are graphs of ``large_graph_statistics``, one after the other.
    """
    items = written(core.select(group, F.col(id).alias("u")))
    edges = activation_ranks(neighbours, group).join(items, [group, "u"], "left_semi").join(items.withColumnRenamed("u", "v"), [group, "v"], "left_semi")
    kind, key = dict(core.dtypes)[id], dict(core.dtypes)[group]
    names, kinds = [c.split()[0] for c in STATISTICS.split(", ")], {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    large = {r[group]: r["n"] for r in items.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") > ONE_TASK_ITEMS).where(F.col(group).isNotNull()).orderBy(group).collect()}
    of_small = ~F.coalesce(F.col(group).isin(list(large)), F.lit(False))

    def tree(nodes: pa.Table, links: pa.Table) -> pa.Table:
        if not nodes.num_rows:
            return pa.table({group: nodes[group], "node": nodes["u"], "component": pa.array([], pa.int64()), **{c.split()[0]: pa.array([], pa.null()) for c in STATISTICS.split(", ")}})
        ids = np.sort(nodes["u"].to_numpy())
        at = lambda c: np.searchsorted(ids, links[c].to_numpy()) if links.num_rows else np.zeros(0, np.int64)
        number = lambda c: links[c].to_numpy() if links.num_rows else np.zeros(0)
        s = graph_statistics(len(ids), at("u"), at("v"), number("rank"), number("dist"), k_cap)
        _, first, of = np.unique(s.pop("labels"), return_index=True, return_inverse=True)  # a component is named by its smallest item
        each = {c.split()[0]: pa.array([s[c.split()[0]]] * len(ids), kinds[c.split()[1]]) for c in STATISTICS.split(", ")}
        return pa.table({group: pa.repeat(nodes[group][0], len(ids)), "node": pa.array(ids, nodes["u"].type), "component": pa.array(ids[first][of].astype(np.int64)), **each})

    if large:
        edges = written(edges)
    rows = written(items.where(of_small).groupBy(group).cogroup(edges.where(of_small).groupBy(group)).applyInArrow(tree, f"{group} {key}, node {kind}, component long, {STATISTICS}"))
    told, parts = rows.select(group, *names).distinct(), rows.select(group, F.col("node").alias(id), "component")
    for value, n in large.items():
        own = F.col(group) == F.lit(value)
        stats, labels = large_graph_statistics(edges.where(own).drop(group), n, k_cap)
        told = told.unionByName(items.sparkSession.createDataFrame([(value, *(stats[c] for c in names))], f"{group} {key}, {STATISTICS}"))
        parts = parts.unionByName(items.where(own).join(labels, F.col("u") == F.col("node"), "left").select(group, F.col("u").alias(id), F.coalesce("component", "u").cast("long").alias("component")))
    return told, parts


KEY_SHIFT = 40  # Nodes of several graphs at once are key << KEY_SHIFT | node.
FINISH_EDGES = 2_000_000


def _local_forests(live: DataFrame) -> DataFrame:
    """The tree edges that are left of contracted graphs, each in one task."""

    def finish(t: pa.Table) -> pa.Table:
        ends = np.concatenate([t["ca"].to_numpy(), t["cb"].to_numpy()])
        _, at = np.unique(ends, return_inverse=True)
        a, b, w = t["a"].to_numpy(), t["b"].to_numpy(), t["w"].to_numpy()
        order = np.lexsort((b, a, w))
        keep = order[forest_edges(int(at.max(initial=-1)) + 1, at[: len(a)][order], at[len(a) :][order])]
        return t.select(["key", "a", "b", "w"]).take(pa.array(keep, pa.int64()))

    return live.groupBy("key").applyInArrow(finish, "key int, a long, b long, w double")


def _thinned(live: DataFrame, most: int) -> DataFrame:
    """``live`` less the edges that are heaviest in a cycle of those that a task goes through, ``most`` at a time: no forest holds such an edge."""
    names = live.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def reduced() -> list[np.ndarray]:
            c = dict(zip(names, (np.concatenate(x) for x in zip(*held, strict=True)), strict=True))
            order = np.lexsort((c["b"], c["a"], c["w"]))
            _, at = np.unique(np.concatenate([c["ca"], c["cb"]]), return_inverse=True)  # a node names its graph, so graphs are one forest
            u, v = at[: len(order)][order], at[len(order) :][order]
            keep = order[forest_edges(int(at.max()) + 1, u, v)]
            return [c[n][keep] for n in names]

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch[n].to_numpy() for n in names])
            size += batch.num_rows
            if size >= most:
                held = [reduced()]
                size = len(held[0][0])
                if 2 * size > most:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in reduced()], names)

    return live.mapInArrow(run, live.schema)


def spanning_forests(edges: DataFrame, finish: int | None = None, max_rounds: int = 60) -> DataFrame:
    """Minimum spanning forests (key, a, b, w) of the graphs in ``edges(key int, a long, b long, w double)``, all at once and of any size.

    In each round every component takes its lightest edge out, ties by the endpoints, so that the
    chosen edges hold no cycle; components become nodes, and of parallel edges the lightest stays.
    The number of nodes at least halves. Once each graph has ``finish`` edges or fewer left, its
    rest is done in one task. As long as that takes away half of the edges, tasks first leave out
    edges that are heaviest in a cycle of their own. Fails if the rounds don't suffice.
    """
    finish = FINISH_EDGES if finish is None else finish
    node = lambda c: F.shiftleft(F.col("key").cast("long"), KEY_SHIFT).bitwiseOR(F.col(c))
    given = edges.select("key", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").where("a < b")
    live = written(given.groupBy("key", "a", "b").agg(F.min("w").alias("w")).select("key", "a", "b", "w", node("a").alias("ca"), node("b").alias("cb")))
    tree = live.select("key", "a", "b", "w").limit(0)
    every, rows = live.count() if finish else 0, live
    while every > finish:
        live = written(_thinned(rows, finish))
        before, every = every, live.count()
        if 2 * every > before:
            break
        rows = live.coalesce(max(1, every // finish))
    if finish and every <= finish:
        return _local_forests(live) if every else tree
    for _ in range(max_rounds):
        left = live.groupBy("key").count().agg(F.max("count")).first()[0] or 0
        if left <= finish:
            return tree.unionByName(_local_forests(live)) if left else tree
        edge = F.struct("w", "a", "b", "ca", "cb", "key").alias("e")
        ends = live.select(F.col("ca").alias("c"), edge).unionByName(live.select(F.col("cb").alias("c"), edge))
        chosen = written(ends.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct())
        tree = tree.unionByName(chosen.select("key", "a", "b", "w"))
        joined = written(connected_components(chosen.select(F.col("ca").alias("a"), F.col("cb").alias("b"))))
        to = lambda side: joined.select(F.col("node").alias(side), F.col("component").alias(f"_{side}"))
        moved = live.join(to("ca"), "ca").join(to("cb"), "cb").where("_ca <> _cb").select("key", F.least("_ca", "_cb").alias("ca"), F.greatest("_ca", "_cb").alias("cb"), F.struct("w", "a", "b").alias("e"))
        live = written(moved.groupBy("key", "ca", "cb").agg(F.min("e").alias("e")).select("key", "e.a", "e.b", "e.w", "ca", "cb"))
    raise RuntimeError(f"forests not done after {max_rounds} rounds")


def boruvka(edges: DataFrame, finish: int | None = None) -> DataFrame:
    """Minimum spanning forest (a, b, w) of ``edges(a, b, w)`` of any size."""
    return spanning_forests(edges.select(F.lit(0).alias("key"), "a", "b", F.col("w").cast("double").alias("w")), finish).select("a", "b", "w")


def rungs_between(start: int, k_cap: int) -> list[int]:
    return sorted({k for k in (*LADDER, k_cap) if start <= k <= k_cap} or {k_cap})


def large_graph_statistics(edges: DataFrame, n: int, k_cap: int, finish: int | None = None) -> tuple[dict, DataFrame]:
    """``graph_statistics`` of a graph that no task holds: ``edges(u, v, rank, dist)`` of n nodes; (statistics, labels(node, component)) with a component's smallest node as its name, for nodes that have an edge.

    One pass of ``spanning_forests`` makes the tree by rank, another the trees of the rungs that connect.
    """
    finish = FINISH_EDGES if finish is None else finish
    by_rank = edges.select(F.lit(0).alias("key"), F.col("u").alias("a"), F.col("v").alias("b"), F.col("rank").cast("double").alias("w"))
    whole = spanning_forests(by_rank, finish).agg(F.count("*").alias("size"), F.max("w").alias("last")).first()
    k_conn = int(whole.last) if n > 1 and whole.size == n - 1 else -1
    open_ = rungs_between(k_conn if k_conn > 0 else k_cap, k_cap)
    rungs = F.array(*(F.lit(k) for k in open_))
    by_rung = edges.where("dist < 1.0").select(F.explode(F.filter(rungs, lambda k: k >= F.col("rank"))).alias("key"), F.col("u").alias("a"), F.col("v").alias("b"), F.col("dist").alias("w"))
    trees = written(spanning_forests(by_rung, finish))
    told = {r.key: r for r in trees.groupBy("key").agg(F.count("*").alias("size"), F.max(F.struct("w", "a", "b")).alias("last")).collect()}
    largest = lambda k: told[k].last.w if k in told else 0.0
    reference = largest(open_[-1])
    k_stable = next(k for k in open_ if reference <= 0 or (largest(k) - reference) / reference <= STABLE_WITHIN)
    tree, top = written(trees.where(F.col("key") == k_stable)), largest(k_stable)
    labels = written(connected_components(tree.select("a", "b"), finish=finish))
    size, second, side, tail = told[k_stable].size if k_stable in told else 0, 0.0, 0, 0
    if size:
        last = told[k_stable].last
        tail = tree.where(F.col("w") >= TAIL_SHARE * top).count()
        rest = tree.where(~((F.col("a") == last.a) & (F.col("b") == last.b)))
        second = rest.agg(F.max("w")).first()[0] or 0.0
        apart = written(connected_components(rest.select("a", "b"), finish=finish))
        ends = {r.node: r.component for r in apart.where(F.col("node").isin(last.a, last.b)).collect()}
        side = min((apart.where(F.col("component") == ends[x]).count() if x in ends else 1) for x in (last.a, last.b))
    lone = tail <= TAIL_MOST or (second > 1e-9 and top / second >= JUMP)
    return {
        "n_main": n, "k_conn": k_conn, "k_stable": k_stable, "k_cap": k_cap, "mst_max_edge": top, "mst_w2": second, "bridge_min_side": side, "components": n - size, "low_pair_count": n < 20,
        "disconnected": n - size > 1, "pathological_bridge": bool(top > 0 and n > 1 and side <= TINY_SIDE and side / n <= TINY_SHARE and lone),
    }, labels
