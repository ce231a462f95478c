"""A group that is dealt to many tasks gives the rows that one task gives."""

import json
from dataclasses import replace

import numpy as np
import pytest

from lakecover.operators import graph
from lakecover.plans import large
from lakecover.plans.config import Config
from lakecover.plans.derep import prepare, select
from lakecover.operators.checkpoints import written

CFG = Config(sketch_size=256, kmer_size=15, embedding_dim=32, k_cap=16, one_task=10**6)
COLUMNS = ["grp", "accession", "signature", "second", "real", "genome_length", "n_real_bins", "quality_score", "excluded", "pinned", "route", "fixed"]


def letters(g):
    return "".join("ACGT"[i] for i in g)


@pytest.fixture(scope="module")
def ready(spark):
    """Four kinds in one group of 150 with copies, strangers, a short text, a missing payload; 30 of another group."""
    rng = np.random.default_rng(3)
    rows = []
    for kind in range(4):
        base = rng.integers(0, 4, 3000)
        for i in range(36):
            g = base.copy()
            at = rng.random(3000) < (0, 0.002, 0.01, 0.04)[i % 4]
            g[at] = rng.integers(0, 4, at.sum())
            rows.append((f"k{kind}-{i:02}", "d__B;s__big", letters(g[: 3000 - 40 * (i % 5)])))
    rows += [(f"z{i}", "d__B;s__big", letters(rng.integers(0, 4, 2500))) for i in range(4)] + [("short", "d__B;s__big", "ACGTACGTACGTACGTACGT"), ("gone", "d__B;s__big", None)]
    base = rng.integers(0, 4, 3000)
    rows += [(f"m{i:02}", "d__B;s__other", letters(np.where(rng.random(3000) < 0.002, 0, base))) for i in range(30)]
    items = spark.createDataFrame(rows, "accession string, taxonomy string, payload string").selectExpr("accession", "taxonomy", "accession as file", "encode(payload, 'utf-8') as payload")
    quality = spark.createDataFrame([(f"k{k}-{i:02}", 90.0 - i, float(i % 3)) for k in range(3) for i in range(0, 36, 2)], "accession string, completeness double, contamination double")
    return written(prepare(items.drop("payload"), items.select("accession", "payload"), CFG, quality=quality).select(COLUMNS))


def compared(got, want):
    got, want = ({r.accession: r for r in x.collect()} for x in (got, want))
    assert set(got) == set(want)
    for key, w in want.items():
        g = got[key]
        for c in ("grp", "representative", "assigned_rep", "component", "method", "flagged", "error"):
            assert g[c] == w[c], (key, c, g[c], w[c])
        for c in ("ani_to_rep", "dist", "isolation", "centroid_distance", "theta", "bin_ani"):
            assert (g[c] is None) == (w[c] is None) and (w[c] is None or g[c] == pytest.approx(w[c], abs=2e-7)), (key, c, g[c], w[c])
        assert (g.statistics is None) == (w.statistics is None)
        if w.statistics:
            a, b = json.loads(g.statistics), json.loads(w.statistics)
            assert a == pytest.approx(b), key
        assert (g.vector is None) == (w.vector is None) and (w.vector is None or np.allclose(g.vector, w.vector, atol=1e-6))


@pytest.mark.parametrize("change", [{}, {"diversity_threshold": 0.05}, {"diversity_threshold": 0.02, "max_rep_fraction": 0.9, "fps_batch": 2}])
def test_a_group_over_the_bound_gives_the_same_rows(spark, ready, change, monkeypatch):
    monkeypatch.setattr(large, "BLOCK_REPS", 3)
    monkeypatch.setattr(large, "STATE_ROUNDS", 3)
    monkeypatch.setattr(graph, "FINISH_EDGES", 0 if not change else 10**6)
    cfg = replace(CFG, **change)
    want = select(ready, cfg)
    got = select(ready, replace(cfg, one_task=100))
    compared(got, want)
    assert 0 < sum(r.representative for r in want.where("grp like '%big'").collect()) < 130


def test_keyed_forests_against_kruskal(spark):
    rng = np.random.default_rng(8)
    edges, want = [], set()
    for key, n in ((1, 40), (2, 3), (5, 90)):
        u, v = rng.integers(0, n, 4 * n), rng.integers(0, n, 4 * n)
        w = np.round(rng.random(4 * n), 1)
        edges += [(key, int(a), int(b), float(x)) for a, b, x in zip(u, v, w, strict=True)]
        least = {}
        for a, b, x in zip(np.minimum(u, v), np.maximum(u, v), w, strict=True):
            if a != b:
                least[int(a), int(b)] = min(least.get((int(a), int(b)), 9), float(x))
        forest = graph.Forest(n)
        want |= {(key, a, b, x) for x, a, b in sorted((x, a, b) for (a, b), x in least.items()) if forest.join(a, b)}
    df = spark.createDataFrame(edges, "key int, a long, b long, w double").repartition(3)
    for finish in (0, 60, 10**6):
        assert {tuple(r) for r in graph.spanning_forests(df, finish).collect()} == want
    with pytest.raises(RuntimeError):
        graph.spanning_forests(df, 0, max_rounds=1)


def test_a_second_run_selects_nothing(spark, ready, tmp_path, monkeypatch):
    from lakecover.plans import derep as D
    from lakecover.sources.stores import EmbeddingStore, Store

    rows = ready.withColumn("file", ready.accession).withColumn("taxonomy", ready.grp)
    store, asked, plain = EmbeddingStore(Store(spark, str(tmp_path))), [], D.select
    monkeypatch.setattr(D, "select", lambda df, cfg: asked.append(df.count()) or plain(df, cfg))
    first = written(D.selected_again(rows, CFG, store))
    second = written(D.selected_again(rows, CFG, store))
    compared(second, first)
    assert asked == [ready.count(), 0]
    changed = rows.withColumn("quality_score", rows.quality_score + (rows.accession == "m03").cast("double"))
    third = D.selected_again(changed, CFG, store)
    assert asked[2] == 30 and third.count() == ready.count()
    assert store.load().count() == first.where("vector is not null").count() == store.index().rows().count()
    assert store.representatives().count() == third.where("representative").count()
    query = store.load().where("accession = 'k1-05'").selectExpr("taxonomy as grp", "accession", "embedding")
    near = [r.dst for r in store.index().search(query, 3, 4).orderBy("rank").collect()]
    assert near and all(x.startswith("k1-") for x in near)
