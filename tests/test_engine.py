"""Sources, stores, catalogue and command line."""

import gzip
import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lakecover.operators import cover, graph, relational
from lakecover.plans import cli, report
from lakecover.plans.oracle import ORACLE
from lakecover.plans.queries import QUERIES
from lakecover.sources import manifest as M
from lakecover.sources.schemas import TABLES
from lakecover.sources.sequences import read_payloads, sequence_lengths
from lakecover.sources.stores import EmbeddingStore, PackStore, SketchStore, Store, StoreMismatchError

QUICK = ["manifest_group_counts", "quality_left_join", "fail_flag_filter", "report_summary", "upsert_merge", "replace_by_group", "upper_median_and_trunc_percentiles", "mad_outliers", "ani_jaccard_functions", "knn_topk", "isolation_outliers", "nearest_rep_assignment", "fps_single", "coverage_metrics", "fixed_and_singleton_routing", "tiny_cover", "minhash_bottom_s", "kmer_words_relational", "oph_bins_relational", "fps_batched"]


def tsv(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, sample, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "labels", "embeddings", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '{sample}/{t}.parquet'")
    got = QUERIES[name](spark, sample).toPandas()
    want = con.sql(ORACLE[name]).df()
    assert set(got.columns) == set(want.columns) and len(got) == len(want)
    shape = lambda d: sorted(tuple(f"{x:.5f}" if isinstance(x, float) else str(x) for x in r) for r in d[sorted(d.columns)].astype(object).itertuples(index=False))
    numbers = lambda d: d.astype({c: "float64" for c in d.columns if d[c].dtype.kind in "iu"})
    assert shape(numbers(got)) == shape(numbers(want))


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "derep_genomes" in entry.queries()


def test_manifest_reader(spark, tmp_path):
    path = tsv(tmp_path / "m.tsv", "# note", "Acc\tLineage\tPath", " a1 \td__B;s__x\tf1.fna.gz", "short", "", "RS_a2\td__B;s__\tf2.fna")
    assert [tuple(r) for r in M.read_manifest(spark, path).orderBy("accession").collect()] == [("RS_a2", "d__B;s__", "f2.fna"), ("a1", "d__B;s__x", "f1.fna.gz")]
    bare = tsv(tmp_path / "b.tsv", "a1\tt\tf", "a1\tt\tg")
    with pytest.raises(M.DuplicateKeyError):
        M.read_manifest(spark, bare)
    assert M.read_manifest(spark, bare, strict=False).count() == 2


def test_side_tables(spark, tmp_path):
    q = M.read_checkm2(spark, tsv(tmp_path / "q.tsv", "Name\tCompleteness\tContamination", "GB_a\t90\t2", "b\tx\t1")).collect()
    assert [tuple(r) for r in q] == [("a", 90.0, 2.0, 80.0)]
    with pytest.raises(ValueError):
        M.read_checkm2(spark, tsv(tmp_path / "w.tsv", "Name\tOther", "a\t1"))
    g = M.read_gunc(spark, tsv(tmp_path / "g.tsv", "genome\tpass.GUNC\tclade_separation_score\tcontamination_portion", "RS_a.fna.gz\tTrue\t0.1\t0.2", "b\tFalse\t0.9\t0.5")).orderBy("accession").collect()
    assert [(r.accession, r.passes) for r in g] == [("a", True), ("b", False)]
    assert M.read_list(spark, tsv(tmp_path / "l.txt", " t1 ", "# c", "t2"), "taxonomy").count() == 2
    e = M.read_ani_edges(spark, tsv(tmp_path / "e.tsv", "Ref_file\tQuery_file\tANI", "b\ta\t98", "a\ta\t100")).collect()
    assert [tuple(r) for r in e] == [("a", "b", 0.98, 1.0, 0.98)]


def test_payloads(spark, tmp_path):
    (tmp_path / "a.fna.gz").write_bytes(gzip.compress(b">x\nACGT\nAC\n"))
    (tmp_path / "bad.gz").write_bytes(b"\x1f\x8bnot")
    got = {r.file.rpartition("/")[2]: r for r in read_payloads(spark, str(tmp_path)).collect()}
    assert bytes(got["a.fna.gz"].payload) == b">x\nACGT\nAC\n" and got["bad.gz"].error
    assert sequence_lengths(spark, str(tmp_path / "a.fna.gz")).first().genome_length == 6


def test_store_changes(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.create_all()
    assert not store.missing() and set(TABLES) == {p.name for p in tmp_path.iterdir()}
    rows = lambda *r: spark.createDataFrame(r, "taxonomy string, count int")
    store.upsert("taxa", rows(("a", 1), ("b", 2)))
    store.upsert("taxa", rows(("b", 3)))
    store.insert_absent("taxa", rows(("a", 9), ("c", 4)))
    store.delete("taxa", rows(("a", 0)), "taxonomy")
    assert sorted(map(tuple, store.read("taxa").collect())) == [("b", 3), ("c", 4)]


def test_special_stores(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    SketchStore(store, 21, 64).open()
    with pytest.raises(StoreMismatchError):
        SketchStore(store, 31, 64).open()
    pack = PackStore(store)
    pack.write(spark.createDataFrame([("a", "t1", b"x"), ("b", "t2", b"y")], "accession string, taxonomy string, payload binary"))
    assert [bytes(r.payload) for r in pack.fetch("t2").collect()] == [b"y"] and pack.done().count() == 2
    e = EmbeddingStore(store)
    row = lambda n: spark.createDataFrame([("a", "t", "f", [0.5] * n, 0.1, 50.0, 5)], "accession string, taxonomy string, file_path string, embedding array<float>, isolation_score float, quality_score float, genome_size bigint")
    e.insert(row(4))
    with pytest.raises(StoreMismatchError):
        e.insert(row(3))
    e.update_isolation(spark.createDataFrame([("a", 0.7)], "accession string, isolation_score double"))
    assert e.load("t").first().isolation_score == pytest.approx(0.7)


def test_components_of_a_chain(spark):
    chain = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).where("a % 20 <> 19")
    got = {r.node: r.component for r in graph.connected_components(chain).collect()}
    assert got == {n: n // 20 * 20 for n in range(60)}


def test_pending_work(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "k int")
    assert [r.k for r in relational.pending(ids(1, 2, 3), ids(1), ids(3, 3), key="k").collect()] == [2]


def test_command_line(spark, tmp_path):
    import random

    rng = random.Random(1)
    lines = ["accession\ttaxonomy\tfile"]
    base = "".join(rng.choice("ACGT") for _ in range(3000))
    for i in range(8):
        seq = base if i < 4 else "".join(rng.choice("ACGT") for _ in range(3000))
        (tmp_path / f"{i}.fna").write_text(f">c\n{seq}\n")
        lines.append(f"g{i}\ts__{'same' if i < 6 else 'other'}\t{tmp_path}/{i}.fna")
    lines.append(f"gone\ts__same\t{tmp_path}/none.fna")
    path = tsv(tmp_path / "m.tsv", *lines)
    code = cli.main(["derep", "-t", path, "-o", str(tmp_path / "store"), "--sketch-size", "256", "--out-dir", str(tmp_path / "out")], spark)
    assert code == 1  # one file is missing
    store = Store(spark, str(tmp_path / "store"))
    got = {r.accession: r for r in store.read("genomes_derep").collect()}
    assert sum(got[f"g{i}"].representative for i in range(4)) == 1 and all(got[f"g{i}"].representative for i in range(4, 8))
    assert [r.accession for r in store.read("jobs_failed").collect()] == ["gone"]
    page = (tmp_path / "out" / "results_report.html").read_text()
    assert json.loads(page.split('type="application/json">')[1].split("</script>")[0])["totals"]["n_taxa"] == 2
    rows = [x.split("\t") for x in (tmp_path / "out" / "results_derep_genomes.tsv").read_text().splitlines()]
    assert rows[0] == ["accession", "taxonomy", "file", "representative"] and [r[:2] for r in rows[1:]] == sorted([r[:2] for r in rows[1:]], key=lambda r: r[::-1]) and len(rows) == 9
    assert len((tmp_path / "out" / "results_stats.tsv").read_text().splitlines()) == 6 and store.read("runs").first().n_items == 9


def test_pages_of_the_report_list_every_group(spark):
    results = spark.createDataFrame([(f"g{k}", "tiny", 3, 1) for k in range(7)], "taxonomy string, method string, n_genomes int, n_genomes_derep int")
    spread = spark.createDataFrame([], "taxonomy string, method string, n_genomes int, n_representatives int, coverage_mean_ani double, coverage_below_95 int")
    stages = spark.createDataFrame([("g1", None)], "taxonomy string, error_message string")
    made = list(report.pages({"results": results, "diversity_stats": spread, "pipeline_stages": stages}, most=3))
    assert [[f"g{k}" for k in range(7) if f'"g{k}"' in page] for page in made] == [["g0", "g1", "g2"], ["g3", "g4", "g5"], ["g6"]]
    assert all("7 groups, 21 items" in page for page in made)
    assert len(list(report.pages({"results": results.limit(0), "diversity_stats": spread, "pipeline_stages": stages}))) == 1


@pytest.mark.parametrize("most", [None, 5])
def test_distributed_cover_is_the_local_one(spark, sample, most):
    items = spark.read.parquet(f"{sample}/embeddings.parquet").withColumn("vector", F.col("embedding").cast("array<double>")).withColumn("one", F.lit(1))
    got = {r.vec_id: (r.pick, r.rep) for r in cover.fps_distributed(items.where("label = 1"), "vec_id", "vector", 0.45, batch=4, most=most).collect()}
    want = {r.vec_id: (r.pick, r.rep) for r in cover.fps(items.where("label = 1"), "vec_id", "vector", "one", 0.45, batch=4).collect()}
    assert got == want if most is None else 5 <= sum(p is not None for p, _ in got.values()) < 5 + 4
