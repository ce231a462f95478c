"""Spanning trees of a task: few edges walk through the union-find, with the results of all of them."""

import numpy as np
import pytest

from lakecover.operators import cover, graph
from lakecover.plans import derep


def plain(n, u, v, dist):
    forest, weights, side = graph.Forest(n), [], 0
    for e in np.lexsort((v, u, dist)):
        if joined := forest.join(int(u[e]), int(v[e])):
            weights.append(float(dist[e]))
            side = joined
    return weights, n - len(weights), side, forest.labels().tolist()


@pytest.mark.parametrize("seed", range(40))
def test_trees_are_those_of_all_edges_in_order(seed):
    rng = np.random.default_rng(seed)
    n, m = int(rng.integers(1, 60)), int(rng.integers(0, 300))
    u, v = rng.integers(0, n, m), rng.integers(0, n, m)
    u, v = np.minimum(u, v)[u != v], np.maximum(u, v)[u != v]
    dist = rng.integers(0, 5, len(u)) / 4 if seed % 2 else rng.random(len(u))
    tree = graph.spanning_tree(n, u, v, dist)
    assert (tree.weights, tree.components, tree.last_side, tree.labels.tolist()) == plain(n, u, v, dist)


def test_no_more_edges_are_walked_than_nodes(monkeypatch):
    walked = []
    monkeypatch.setattr(graph.Forest, "join", lambda self, a, b, real=graph.Forest.join: walked.append(1) or real(self, a, b))
    rng = np.random.default_rng(1)
    u, v = rng.integers(0, 100, 5000), rng.integers(100, 200, 5000)
    graph.spanning_tree(201, u, v, rng.random(5000))
    assert len(walked) <= 200


def test_neighbours_are_taken_few_products_at_a_time(monkeypatch):
    v = np.random.default_rng(2).normal(size=(300, 5))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    sizes = []

    def near(i):
        sizes.append(len(i))
        return np.round(v[i] @ v.T, 12)

    whole = derep.nearest(near, 300, 7)
    reps = np.arange(0, 300, 2)
    merged, assigned = cover.merge_close(reps, v, 0.1), cover.assign(v, reps)
    sizes.clear()
    for module in (derep, cover):
        monkeypatch.setattr(module, "PRODUCTS", 3000)
    assert all(np.array_equal(a, b) for a, b in zip(derep.nearest(near, 300, 7), whole, strict=True)) and max(sizes) == 10
    assert np.array_equal(cover.merge_close(reps, v, 0.1), merged) and all(np.array_equal(a, b) for a, b in zip(cover.assign(v, reps), assigned, strict=True))


def test_passing_tables_go_and_kept_ones_stay(spark):
    import os

    from lakecover.operators.checkpoints import passing, written

    there = lambda df: all(os.path.exists(f.removeprefix("file://")) for f in df)
    with passing(spark) as keep:
        inner = written(spark.range(5)).inputFiles()
        with passing(spark) as keep_in:
            deep = written(spark.range(3)).inputFiles()
            middle = keep_in(spark.range(4))
        assert not there(deep[:1]) and middle.count() == 4
        kept = keep(middle)
    assert not there(inner[:1]) and not there(middle.inputFiles()[:1]) and kept.count() == 4
    assert there(written(spark.range(2)).inputFiles())
