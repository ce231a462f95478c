"""Operators that no longer test or query reaches."""

import gzip

import numpy as np
import pandas as pd
import pytest
import zstandard
from pyspark.sql import functions as F

from lakecover.functions import aggregates as A
from lakecover.functions import kernels as K
from lakecover.operators import anomaly, certify, metrics, postings, relational, similarity, sketch
from lakecover.plans import derep as D
from lakecover.plans.config import Config
from lakecover.sources import manifest as M
from lakecover.sources.sequences import read_payloads, sequence_lengths
from lakecover.sources.stores import EmbeddingStore, Store
from lakecover.streaming import incremental


def unit(rows):
    return [x / np.linalg.norm(x) for x in np.asarray(rows, float)]


def test_size_tiers_and_status_counts(spark):
    groups = spark.createDataFrame([(i, i) for i in range(1, 101)], "g int, n int")
    got = {r.tier: r["count"] for r in relational.size_tiers(groups).groupBy("tier").count().collect()}
    assert got == {"giant": 5, "large": 20, "medium": 50, "small": 25}
    assert {r.status: r.n for r in A.status_counts(spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "status string")).collect()} == {"a": 2, "b": 1, None: 1}


def test_vector_search_by_both_metrics(spark):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit([[1, 0], [1, 0.1], [0, 1], [-1, 0], [1, 0.1]]))], "id long, v array<double>")
    assert [r.id for r in similarity.vector_search(rows, [1.0, 0.1], "id", "v", 3).collect()] == [1, 4, 0]
    assert [r.id for r in similarity.vector_search(rows, [0.0, 1.0], "id", "v", 2, where="id <> 2", metric="l2").collect()] == [1, 4]


def test_nearest_three_representatives(spark):
    rng = np.random.default_rng(1)
    v = unit(rng.normal(size=(30, 5)))
    rows = spark.createDataFrame([(i, i % 2, x.tolist()) for i, x in enumerate(v)], "id long, g int, v array<double>")
    got = similarity.nearest_representative(rows, rows.where("id < 12"), "id", "v", "g", k=3).collect()
    for i in range(30):
        want = sorted((r for r in range(12) if r % 2 == i % 2), key=lambda r: (-np.round(v[i] @ v[r], 12), r))[:3]
        assert [r.rep for r in sorted((x for x in got if x.id == i), key=lambda x: x.rank)] == want


def test_set_similarity_of_pairs(spark):
    rows = spark.createDataFrame([(i, s) for i, items in enumerate(("abc", "bcd", "xyz", "abc")) for s in items], "id long, item string")
    got = {(r.a, r.b): r.jaccard for r in sketch.set_jaccard(rows, "id", "item").collect()}
    assert got == {(0, 1): 0.5, (0, 3): 1.0, (1, 3): 0.5}
    assert sketch.set_jaccard(rows, "id", "item", spark.createDataFrame([(0, 3)], "a long, b long")).count() == 1


def test_best_identity_to_a_representative(spark):
    edges = spark.createDataFrame([("a", "r", 97.0), ("r", "b", 91.0), ("b", "s", 95.0), ("a", "b", 99.0)], "source string, target string, ani double")
    items = spark.createDataFrame([(x,) for x in "abcrs"], "accession string")
    got = {r.accession: r.ani for r in metrics.best_ani(edges, items.where("accession in ('r', 's')"), items).collect()}
    assert got == {"a": 97.0, "b": 95.0, "c": None}
    assert {r.accession for r in metrics.coverage_gate(spark.createDataFrame(list(got.items()), "accession string, ani double"), 96.0).collect()} == {"b", "c"}


def test_pairs_without_real_bins_count_nowhere(spark):
    rows = spark.createDataFrame([("g", 0.45, None), ("g", 0.45, -1.0), ("g", 0.45, 96.0), ("g", 0.0, 99.5)], "g string, dist double, bin_ani double")
    got = metrics.coverage(rows, "g").first()
    assert (got.coverage_below_99, got.coverage_below_97, got.coverage_below_95, got.n) == (2, 2, 1, 4)
    assert D.bin_ani(np.array([np.nan, 0.0, 1.0]), 21).tolist() == [-1.0, 0.0, 100.0]


def test_isolation_forest_and_default_depth(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(200, 3)), [[9, 9, 9]]])
    assert anomaly.IsolationForest(trees=30).scores(x).argmax() == 200
    items = spark.createDataFrame([(i, "g") for i in range(30)] + [(99, "alone")], "id long, g string")
    near = spark.createDataFrame([("g", i, (i + k) % 30, k, float(k)) for i in range(30) for k in range(1, 15)], "g string, src long, dst long, rank int, dist double")
    got = {r.id: r.isolation for r in anomaly.isolation_scores(near, items, "g", "id").collect()}
    assert got[0] == 5.5 and got[99] == 1.0


def test_a_graph_that_falls_apart_is_tried_again(monkeypatch):
    asked, plain = [], D.nearest
    monkeypatch.setattr(D, "nearest", lambda near, n, k: asked.append(k) or plain(near, n, k))
    rng = np.random.default_rng(4)
    base = rng.integers(0, 60000, (2, 64))
    sig = np.array([np.where(rng.random(64) < 0.95, base[i % 2], rng.integers(0, 60000, 64)) for i in range(120)]).astype(np.uint16)
    n = len(sig)
    cfg = Config(sketch_size=64, kmer_size=9, embedding_dim=16, k_cap=8, k_cap_max=30)
    got = D.select_group(sig, None, np.ones((n, 64), bool), np.full(n, 60.0), np.full(n, 100.0), np.zeros(n, bool), np.zeros(0, np.int64), np.array([f"i{k:03}" for k in range(n)]), cfg)
    assert asked[:2] == [8, 119] and got["stats"]["k_conn"] > 8
    short = D.select_group(sig[:110], None, np.ones((110, 64), bool), np.full(110, 60.0), np.full(110, 100.0), np.zeros(110, bool), np.zeros(0, np.int64), np.array([f"i{k:03}" for k in range(110)]), cfg)
    assert short["stats"]["k_conn"] > 8


def test_bridges_between_components():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 60000, 64).astype(np.uint16)
    b = np.where(np.arange(64) < 40, a, rng.integers(0, 60000, 64)).astype(np.uint16)
    cfg = Config(kmer_size=9)
    stack = np.stack([a, b, rng.integers(0, 60000, 64).astype(np.uint16)])
    assert D.bridge_diagnosis(np.array([0, 1]), np.array([0, 1]), stack, cfg)["bridge"] == "recall gap"
    told = D.bridge_diagnosis(np.array([0, 1]), np.array([0, 2]), stack, cfg)
    assert told["bridge"] == "none found" and told["bridge_pairs"] == 1


def test_calibration_takes_a_tier(spark):
    rng = np.random.default_rng(6)
    base = "".join(rng.choice(list("ACGT"), 4000))
    rows = [(f"i{k}", bytearray(base.encode())) for k in range(60)]
    items = spark.createDataFrame(rows, "accession string, payload binary")
    cfg = D.calibrated_run(items.select("accession"), items, Config(sketch_size=128))
    assert (cfg.kmer_size, cfg.sketch_size, cfg.embedding_dim) == (31, 20_000, 512)
    assert D.calibrated_run(items.limit(5).select("accession"), items, Config(sketch_size=128)).kmer_size == 21


def test_windows_and_affected_groups(spark):
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:00:00", "a")], "t string, k string").select(F.to_timestamp("t").alias("t"), "k")
    assert sorted(r.n for r in incremental.windowed_counts(events, "t", "k").collect()) == [1, 2]
    rows = spark.createDataFrame([("g", 1), ("h", 2)], "g string, x int")
    assert [r.x for r in incremental.affected_groups(rows.where("g = 'h'"), rows, "g").collect()] == [2]


def test_arriving_manifests(spark, tmp_path):
    rng = np.random.default_rng(7)
    schema = "accession string, taxonomy string, file string, payload binary"
    rows = [(f"x{i}", f"s__{i % 2}", "f", bytearray("".join(rng.choice(list("ACGT"), 900)).encode())) for i in range(8)]
    cfg, store = Config(sketch_size=64, kmer_size=11), Store(spark, str(tmp_path / "store"), 4)
    for part in (rows[:5], rows[5:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        incremental.stream_manifest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), store, cfg, str(tmp_path / "c")).awaitTermination()
    assert store.read("genomes_derep").count() == 8 and {t: store.stage(t) for t in ("s__0", "s__1")} == {"s__0": 7, "s__1": 7}


def test_payload_files_of_every_kind(spark, tmp_path):
    for name, content in (("a.zst", zstandard.compress(b">h\nAC GT\n")), ("b.gz", gzip.compress(b"ACGTN")), ("c.fa", b">h\nAC\nGT\n"), ("d.gz", b"\x1f\x8bbroken")):
        (tmp_path / name).write_bytes(content)
    got = {r.file.rsplit("/", 1)[1]: (r.payload and bytes(r.payload), bool(r.error)) for r in read_payloads(spark, str(tmp_path)).collect()}
    assert got == {"a.zst": (b">h\nAC GT\n", False), "b.gz": (b"ACGTN", False), "c.fa": (b">h\nAC\nGT\n", False), "d.gz": (None, True)}
    assert sequence_lengths(spark, str(tmp_path / "c.fa"), strict=True).first().genome_length == 4
    (tmp_path / "head.fa").write_text(">h one\n>k\n")
    assert sequence_lengths(spark, str(tmp_path / "head.fa"), strict=True).first().genome_length == 0
    (tmp_path / "bad.fa").write_text(">h\nAC!T\n")
    with pytest.raises(Exception, match="not a sequence"):
        sequence_lengths(spark, str(tmp_path / "bad.fa"), strict=True).collect()


def test_embedding_store_changes(spark, tmp_path):
    e = EmbeddingStore(Store(spark, str(tmp_path), 4))
    row = lambda a, t, v: (a, t, "f", v, 0.5, 50.0, 10)
    schema = "accession string, taxonomy string, file_path string, embedding array<float>, isolation_score float, quality_score float, genome_size bigint"
    e.insert(spark.createDataFrame([row("a", "t", [1.0, 0.0]), row("b", "u", [0.0, 1.0])], schema))
    assert e.dimension() == 2 and e.has("a") and not e.has("z") and e.pending(spark.createDataFrame([("a",), ("z",)], "accession string")).first().accession == "z"
    e.update_isolation(spark.createDataFrame([("a", 0.9)], "accession string, isolation_score double"))
    assert e.load("t").first().isolation_score == pytest.approx(0.9) and e.load("u").first().isolation_score == pytest.approx(0.5)
    e.set_representatives(spark.createDataFrame([("a", "t"), ("b", "u")], "accession string, taxonomy string"))
    assert e.representative_rows().count() == 2
    e.clear_representatives("t")
    assert [r.accession for r in e.representative_rows().collect()] == ["b"]
    e.delete_group("u")
    e.delete(spark.createDataFrame([("a",)], "accession string"))
    assert e.load().count() == 0


@pytest.mark.parametrize("q", [0.3, 0.7])
def test_certified_pairs_by_postings_are_the_plain_ones(spark, q):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 60000, (5, 64))
    rows, sig, real = [], [], []
    for i in range(90):
        s = np.where(rng.random(64) < rng.choice([0.3, 0.6, 0.95]), base[i % 5], rng.integers(0, 60000, 64)).astype("<u2")
        s = base[0].astype("<u2") if i % 9 == 0 else s
        r = rng.random(64) < (0.2, 0.5, 1.0)[i % 3]
        sig.append(s)
        real.append(r)
        rows.append((i, "ab"[i % 2], s.tobytes(), np.packbits(r, bitorder="little").tobytes(), int(r.sum())))
    items = spark.createDataFrame(rows, "id long, grp string, signature binary, real binary, n_real_bins int").repartition(3)
    got = {r.id: r.rep for r in postings.most_similar_certified(items, items.where("id % 4 < 2"), "id", "grp", q, 64).collect()}
    sig, real, want = np.stack(sig), np.stack(real), {}
    for i in range(90):
        fit = [(-K.jaccard_16(sig[i], sig[r]), r) for r in range(90) if r % 4 < 2 and r % 2 == i % 2 and r != i and certify._certified_rows(sig, real, np.array([r]), np.array([i]), q)[0]]
        want[i] = min(fit)[1] if fit else None
    assert got == want and 20 < sum(r is not None for r in want.values()) < 90


def test_kernels_of_words():
    assert K.fnv1a_hex("") == "cbf29ce484222325"
    assert pd.Series(K.bottom_sketch(K.shingle_words("abcdefghij" * 3, 4), 5)).is_monotonic_increasing


def test_fixed_taxa(spark, tmp_path):
    (tmp_path / "fixed.tsv").write_text("taxonomy\taccession\ns__a\tGCF_1\n# note\n\ns__b\tGCF_2\n")
    assert sorted(map(tuple, M.read_fixed_taxa(spark, str(tmp_path / "fixed.tsv")).select("taxonomy", "accession").collect())) == [("s__a", "GCF_1"), ("s__b", "GCF_2")]
