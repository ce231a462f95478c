"""Pairs of a group by blocks: all of them, each once, in batches."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakecover.functions import kernels as K
from lakecover.operators import graph, metrics, similarity, sketch


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 8))
    v[150:200] = v[:50]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, i % 2, v[i].tolist()) for i in range(300)], "id long, g int, v array<double>")
    return v, df


def plain(v, least):
    c = np.round(v @ v.T, 12)
    return {(a, b) for a in range(len(v)) for b in range(a + 1, len(v)) if a % 2 == b % 2 and c[a, b] >= least}


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_close_pairs_at_any_block(spark, points, block, monkeypatch):
    monkeypatch.setattr(similarity, "PAIRS", 100)
    v, df = points
    for least in (None, 0.6):
        rows = similarity.close_pairs(df, "id", "v", "g", least_cosine=least, block=block).collect()
        assert len(rows) == len({(r.src, r.dst) for r in rows}) and {(r.src, r.dst) for r in rows} == plain(v, -2 if least is None else least)
    found = graph.connected_components(similarity.radius_links(df, "id", "v", "g", np.arccos(0.9) / np.pi, block)).collect()
    pairs = spark.createDataFrame(sorted(plain(v, 0.9)), "a long, b long")
    assert sorted(map(tuple, found)) == sorted(map(tuple, graph.connected_components(pairs).collect()))


def test_links_are_few_where_pairs_are_many(spark):
    df = spark.range(400).select("id", F.lit(0).alias("g"), F.array(F.lit(1.0), F.lit(0.0)).alias("v"))
    assert similarity.radius_links(df, "id", "v", "g", 0.1).count() == 399


@pytest.mark.parametrize("k", [1, 4, 40])
def test_nearest_of_wide_blocks(points, k, monkeypatch):
    v, df = points
    want = []
    for i in range(len(v)):
        others = [j for j in range(i % 2, len(v), 2) if j != i]
        c = np.round(v[others] @ v[i], 12)
        want += [(i, others[j], n + 1) for n, j in enumerate(np.lexsort((others, -c))[:k])]
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 16)
    monkeypatch.setattr(similarity, "WIDE", 3)
    monkeypatch.setattr(similarity, "PRODUCTS", 200)
    assert sorted((r.src, r.dst, r["rank"]) for r in similarity.knn(df, "id", "v", "g", k).collect()) == sorted(want)


def test_many_equal_values_are_cut_to_the_earlier():
    c = np.array([[0.5] * 300 + [0.9] * 3 + [0.5 + 1e-14] * 300])
    rows, cols, value = similarity._largest(c, 8, 12)
    assert cols.tolist() == [300, 301, 302, 0, 1, 2, 3, 4] and value.tolist() == [0.9] * 3 + [0.5] * 5


def test_a_task_hands_on_no_more_candidates_than_wide_blocks_ask_for(points, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 10)
    seen = []
    monkeypatch.setattr(similarity, "_dealt", lambda rows, side, block, other, far, real=similarity._dealt: seen.append((side, block, far)) or real(rows, side, block, other, far))
    similarity.block_join(points[1], points[1], "id", "v", "g", k=2)
    similarity.block_join(points[1], points[1], "id", "v", "g", least_cosine=0.5)
    assert seen == [("a", 10, 160), ("b", 160, 10), ("a", 10, 10), ("b", 10, 10)]


def test_a_task_makes_its_pairs_in_batches(spark):
    """2,000 copies are 2 million pairs: none of the batches may hold them all."""
    df = spark.range(2000).select("id", F.lit(0).alias("g"), F.array(F.lit(1.0), F.lit(0.0)).alias("v"))
    sizes = similarity.close_pairs(df, "id", "v", "g").mapInArrow(lambda it: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in it), "n long").collect()
    assert sum(r.n for r in sizes) == 2000 * 1999 // 2 and max(r.n for r in sizes) <= similarity.PAIRS


@pytest.mark.parametrize("block", [5, 8192])
def test_sketch_pairs_by_blocks(spark, block, monkeypatch):
    monkeypatch.setattr(sketch, "PAIRS", 60)
    rng = np.random.default_rng(5)
    s = rng.integers(0, 1 << 16, (60, 64)).astype("<u2")
    for i in range(20, 60):  # a quarter of the bins of another; the last are copies
        s[i, :16] = s[i - 20, :16]
    s[50:] = s[40]
    df = spark.createDataFrame([(i, f"g{i % 3}", bytes(s[i].tobytes())) for i in range(60)] + [(60, "g0", None)], "id long, g string, signature binary")
    j = K.jaccard_matrix(s, s)
    for over in (None, 0.0, 0.05, 0.9):
        want = sorted((f"g{a % 3}", a, b, j[a, b]) for a in range(60) for b in range(a + 1, 60) if a % 3 == b % 3 and (over is None or j[a, b] > over))
        assert sorted(map(tuple, sketch.sketch_pairs(df, "id", "g", over, block).collect())) == want


def test_all_pairs_count_for_diversity(spark):
    """More pairs than ``sampled_pairs`` draws: their spread is that of all of them."""
    n = metrics.MOST_PAIRS + 500
    pairs = spark.range(n).select(F.lit("x").alias("g"), F.col("id").alias("a"), (F.col("id") + n).alias("b"), (F.col("id") / (2.5 * n)).alias("dist"))
    row = metrics.diversity(pairs, "g").first()
    want = spark.range(1).select(*(metrics.distance_to_ani(F.lit(x), 21) for x in ((n - 1) / 2 / (2.5 * n), (n * 95 // 100) / (2.5 * n), (n * 5 // 100) / (2.5 * n)))).first()
    assert row.diversity_n_pairs == n and np.allclose([row.diversity_mean_ani, row.diversity_min_ani, row.diversity_max_ani], list(want))
