"""What the graph of one group holds at once, and that forests by runs of edges are those of all edges."""

import tracemalloc

import numpy as np
import pytest

from lakecover.operators import graph
from lakecover.plans.derep import core_graph


def test_a_graph_holds_few_bytes_an_edge():
    n, k = 20_000, 48
    r = np.random.default_rng(1)
    at = (np.arange(n)[:, None] + r.integers(1, n, (n, k))) % n
    at, dist = at.astype(np.int32), np.sort(r.random((n, k)), axis=1)
    tracemalloc.start()
    core_graph(at, dist, np.arange(n), n)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak / (n * k) < 130


@pytest.mark.parametrize("edges", [1, 7, 64, 10_000])
def test_forests_by_runs_of_edges(edges, monkeypatch):
    for seed in range(20):
        r = np.random.default_rng(seed)
        n = int(r.integers(2, 60))
        u, v = r.integers(0, n, (2, int(r.integers(0, 200))))
        forest = graph.Forest(n)
        kept = [i for i, (a, b) in enumerate(zip(u, v, strict=True)) if forest.join(int(a), int(b))]
        monkeypatch.setattr(graph, "EDGES", edges, raising=False)
        assert graph.forest_edges(n, u, v).tolist() == kept
