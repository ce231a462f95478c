"""Edges that no forest holds go before the rounds of joins."""

import numpy as np

from lakecover.operators import graph


def test_a_graph_of_many_edges_needs_no_round_of_joins(spark, monkeypatch):
    rng = np.random.default_rng(2)
    n, edges = 300, []
    for key in (1, 4):
        u, v = rng.integers(0, n, 30_000), rng.integers(0, n, 30_000)
        edges += [(key, int(a), int(b), float(x)) for a, b, x in zip(u, v, np.round(rng.random(30_000), 3), strict=True)]
    df = spark.createDataFrame(edges, "key int, a long, b long, w double").repartition(4)
    want = {tuple(r) for r in graph.spanning_forests(df, 10**6).collect()}
    assert len(want) == 2 * (n - 1)
    asked = []
    plain = graph.connected_components
    monkeypatch.setattr(graph, "connected_components", lambda *a, **k: asked.append(1) or plain(*a, **k))
    assert {tuple(r) for r in graph.spanning_forests(df, 2000).collect()} == want
    assert not asked
