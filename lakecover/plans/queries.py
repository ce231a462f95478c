"""The engine's operators as queries over the sample tables; each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import kernels as K
from ..functions import registry
from ..functions import scalar as S
from ..operators import anomaly, calibrate, cells, cover, graph, metrics, postings, relational, similarity, sketch
from ..operators.checkpoints import shared_folder, written
from ..sources.buckets import BucketTable
from ..sources.stores import SketchStore, Store
from ..streaming import incremental, state
from . import large, report
from .config import Config
from .derep import derep

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TEXT = Config(sketch_size=512, payload_kind="text", embedding_dim=64, k_cap=32)
THETA = 0.45
RADIUS = 0.45


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """Documents as items: a source of a language is a species; every 17th is unresolved."""
    species = F.when(F.col("doc_id") % 17 == 0, "").otherwise(F.col("source"))
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("accession"), F.concat(F.lit("d__"), F.col("lang"), F.lit(";s__"), species).alias("taxonomy"), F.col("source").alias("file"), "text", "n_chars", "doc_id", "lang", "source")


def neighbours(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    return similarity.knn(table(spark, d, "embeddings"), "vec_id", "embedding", "label", k)


def isolation(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return anomaly.isolation_scores(neighbours(spark, d), e, "label", "vec_id", k=10)


# -- relational layer


@query
def manifest_group_counts(spark, d):
    return relational.group_items(manifest(spark, d)).select("group", "n")


@query
def quality_left_join(spark, d):
    quality = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("accession"), (100.0 * F.col("quality")).alias("completeness"), F.col("toxic").cast("double").alias("contamination"))
    return relational.attach_quality(manifest(spark, d), quality).select("doc_id", "completeness", "contamination", "quality_score")


@query
def quality_coverage_count(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi").agg(F.count("*").alias("n_with_quality"))


@query
def selected_groups_semi(spark, d):
    docs = table(spark, d, "documents")
    wanted = docs.where("source like '%1'").select("source").distinct()
    return relational.prune_to(docs, wanted, "source").groupBy("source", "lang").agg(F.count("*").alias("n"))


@query
def pending_work_anti(spark, d):
    return relational.pending(table(spark, d, "documents"), table(spark, d, "labels"), key="doc_id").select("doc_id", "lang")


@query
def fail_flag_filter(spark, d):
    checks = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("accession"), (F.col("toxic") == 0).alias("passes"))
    return relational.failing(manifest(spark, d), checks).select("doc_id", "lang")


@query
def canonical_keys(spark, d):
    return table(spark, d, "pages").select(
        "page_id", S.path_stem(F.col("url")).alias("stem"), S.canonical_accession(F.concat(F.lit("RS_"), F.col("page_id").cast("string"))).alias("canonical"),
        S.strip_sequence_suffix(F.concat(F.lit("g"), F.col("page_id").cast("string"), F.lit(".fna.gz"))).alias("stripped"))


@query
def lineage_extract(spark, d):
    joined = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lineage = F.concat(F.lit("d__"), F.col("r_name"), F.lit(";p__"), F.col("n_name"), F.lit(";s__"), F.when(F.col("n_nationkey") % 5 == 0, "").otherwise(F.col("n_name")))
    rows = joined.select("n_nationkey", lineage.alias("lineage"))
    return rows.select("n_nationkey", S.lineage_field(F.col("lineage"), "d").alias("domain"), S.lineage_field(F.col("lineage"), "s").alias("species"), S.has_empty_species(F.col("lineage")).alias("unresolved"))


def _run_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    groups = table(spark, d, "documents").groupBy(F.concat_ws(";", "lang", "source").alias("taxonomy")).agg(F.count("*").alias("n_genomes"), F.avg("n_chars").alias("m"))
    results = groups.select("taxonomy", F.when(F.col("n_genomes") <= 10, "singleton").when(F.col("n_genomes") <= 20, "tiny").otherwise("embedded").alias("method"), "n_genomes", F.ceil(F.col("n_genomes") / 4).alias("n_genomes_derep"))
    diversity = groups.select("taxonomy", (90 + F.col("m") / 1000).alias("coverage_mean_ani"), (F.col("n_genomes") % 3).alias("coverage_below_95"))
    stages = groups.select("taxonomy", F.when(F.col("n_genomes") % 7 == 0, "failed").alias("error_message"))
    return {"results": results, "diversity_stats": diversity, "pipeline_stages": stages}


@query
def report_summary(spark, d):
    t = _run_tables(spark, d)
    return report.totals(t["results"], t["diversity_stats"], t["pipeline_stages"]).withColumn("mean_coverage_ani", r6("mean_coverage_ani"))


@query
def report_histograms(spark, d):
    sizes = table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").cast("double").alias("n"))
    prices = A.histogram(table(spark, d, "part"), "p_retailprice", [0, 900, 1000, 1100, 1500, 2500]).withColumn("what", F.lit("price"))
    return A.histogram(sizes, "n", [1, 2, 11, 21, 51, 1001]).withColumn("what", F.lit("size")).unionByName(prices)


@query
def topk_groups_sorted(spark, d):
    groups = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("taxonomy"), "c_nationkey").agg(F.count("*").alias("n"))
    return report.search(groups.where("n > 0"), text="b", sort="n", descending=True, page=0, size=1000).groupBy("taxonomy").agg(F.sum("n").alias("n"))


@query
def ordered_fetch_with_miss(spark, d):
    docs = table(spark, d, "documents")
    keys = docs.select((F.col("doc_id") * 2).alias("doc_id"), F.col("doc_id").alias("ord"))
    return relational.ordered_fetch(keys, docs.select("doc_id", "lang"), "doc_id", "ord").select("ord", "doc_id", "lang", "found")


@query
def upsert_merge(spark, d):
    old = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    new = old.where("s_suppkey % 3 = 0").select((F.col("s_suppkey") * 2).alias("s_suppkey"), "s_nationkey", (F.col("s_acctbal") + 1).alias("s_acctbal"))
    merged = relational.upsert(old, new, ["s_suppkey"])
    more = new.select((F.col("s_suppkey") + 1).alias("s_suppkey"), "s_nationkey", F.lit(0.0).alias("s_acctbal"))
    changed = relational.insert_absent(merged, more, ["s_suppkey"])
    return relational.update_from(changed, table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("s_suppkey"), (F.col("n_regionkey") + 100).alias("s_nationkey")), "s_suppkey", ["s_nationkey"]).withColumn("s_acctbal", r6("s_acctbal"))


@query
def replace_by_group(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    new = lines.where("l_suppkey % 4 = 0 and l_returnflag = 'R'").withColumn("n", -F.col("n"))
    return relational.replace_groups(lines, new, "l_suppkey")


@query
def set_difference_reps(spark, d):
    docs = table(spark, d, "documents")
    picks = docs.groupBy("lang", "source").agg(F.min("doc_id").alias("doc_id"))
    kept = docs.groupBy("lang").agg(F.min("doc_id").alias("doc_id"))
    pinned = relational.prune_to(docs.select("doc_id"), table(spark, d, "labels"), "doc_id")
    return picks.select("doc_id").exceptAll(kept.select("doc_id")).join(pinned.select("doc_id", F.lit(True).alias("pinned")), "doc_id", "left").withColumn("pinned", F.coalesce("pinned", F.lit(False)))


# -- statistics


@query
def group_moments_zscore(spark, d):
    docs = table(spark, d, "documents")
    joined = docs.join(A.group_moments(docs, ["lang"], "n_chars"), "lang")
    z = S.zscore(F.col("n_chars").cast("double"), F.col("mean"), F.col("sd_samp"))
    return joined.select("doc_id", r6(z).alias("z"), r6("sd_pop").alias("sd_pop"), S.flag_reason(z, F.lit(0.0), F.lit(0), 2.0).alias("reason"))


@query
def upper_median_and_trunc_percentiles(spark, d):
    docs = table(spark, d, "documents")
    low = A.group_percentiles(docs, ["lang"], "n_chars", (5, 25, 75, 95)).join(A.group_upper_median(docs, ["lang"], "n_chars"), "lang")
    lines = table(spark, d, "lineitem").withColumn("lang", F.col("l_returnflag"))
    return low.unionByName(A.group_percentiles(lines, ["lang"], "l_quantity", (5, 25, 75, 95)).join(A.group_upper_median(lines, ["lang"], "l_quantity"), "lang"))


@query
def mad_outliers(spark, d):
    docs = table(spark, d, "documents").withColumn("n_chars", F.col("n_chars").cast("double"))
    return docs.join(A.mad_threshold(docs, ["lang"], "n_chars", 2.0), "lang").where("n_chars > threshold").select("doc_id", "lang", "n_chars", r6("threshold").alias("threshold"))


@query
def ani_jaccard_functions(spark, d):
    x = (F.col("p_size") % 51) / 50
    rows = table(spark, d, "part").select("p_partkey", x.alias("x"))
    x = F.col("x")
    return rows.select(
        "p_partkey", r6(S.jaccard_to_ani(x, 21)).alias("ani"), r6(S.jaccard_to_ani_fraction(x, 21)).alias("fraction"), r6(S.distance_to_ani(x / 2, 21)).alias("distance_ani"),
        r6(S.ani_to_jaccard(0.7 + 0.3 * x, 21)).alias("jaccard"), r6(S.ani_to_theta(0.7 + 0.3 * x, 21)).alias("theta"), r6(S.mash_distance(x, 21)).alias("mash"))


# -- neighbours


@query
def angular_distance_pairs(spark, d):
    return similarity.all_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", "label").select("label", "a", "b", r6("dist").alias("dist"))


@query
def knn_topk(spark, d):
    return neighbours(spark, d, 5).select("label", "src", "dst", "rank", r6("dist").alias("dist"))


@query
def knn_filtered_vector_search(spark, d):
    return similarity.search_by_key(table(spark, d, "embeddings"), 7, "vec_id", "embedding", 10, "label").select("vec_id", r6("score").alias("score"))


@query
def isolation_scores(spark, d):
    return isolation(spark, d).select("vec_id", "label", r6("isolation").alias("isolation"))


@query
def isolation_outliers(spark, d):
    iso = isolation(spark, d)
    return iso.join(A.mad_threshold(iso, ["label"], "isolation", 2.0), "label").where("isolation > threshold").select("vec_id", "label", r6("isolation").alias("isolation"), r6("threshold").alias("threshold"))


@query
def centroid_distance(spark, d):
    return anomaly.centroid_distances(table(spark, d, "embeddings"), "vec_id", "embedding", "label").select("vec_id", "label", r6("centroid_distance").alias("centroid_distance"))


@query
def core_filter_mean_2sigma(spark, d):
    return graph.core_items(isolation(spark, d), "label").select("vec_id", "label", r6("isolation").alias("isolation"))


@query
def mutual_rank_edges(spark, d):
    return graph.activation_ranks(neighbours(spark, d), "label").select("label", "u", "v", "rank", r6("dist").alias("dist"))


@query
def connected_components(spark, d):
    found = graph.connected_components(similarity.radius_links(table(spark, d, "embeddings"), "vec_id", "embedding", "label", RADIUS))
    return table(spark, d, "embeddings").select("vec_id").join(found.withColumnRenamed("node", "vec_id"), "vec_id", "left").select("vec_id", F.coalesce("component", "vec_id").alias("component"))


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    core = graph.core_items(isolation(spark, d), "label")
    return graph.mst_statistics(neighbours(spark, d, 20), core, "label", "vec_id", 20)


@query
def knn_k_conn(spark, d):
    return _graph(spark, d)[0].select("label", "n_main", "k_conn", "k_stable", "disconnected")


@query
def mst_bottleneck(spark, d):
    return _graph(spark, d)[0].select("label", "n_main", r6("mst_max_edge").alias("mst_max_edge"), r6("mst_w2").alias("mst_w2"), "bridge_min_side", "components", "pathological_bridge")


@query
def mst_distributed(spark, d):
    edges = graph.activation_ranks(neighbours(spark, d), "label").select(F.col("u").alias("a"), F.col("v").alias("b"), F.col("dist").alias("w"))
    return graph.boruvka(edges).select("a", "b", r6("w").alias("w"))


@query
def theta_resolution(spark, d):
    stats = _graph(spark, d)[0]
    first = A.group_percentiles(neighbours(spark, d, 1), ["label"], "dist", (5, 95))
    unstable = F.col("low_pair_count") | F.col("disconnected") | F.col("pathological_bridge")
    natural = F.when(unstable | (F.col("mst_max_edge") <= 0), F.col("p95")).otherwise(F.col("mst_max_edge"))
    theta = F.greatest(F.lit(1e-6), F.least(F.lit(THETA), natural))
    return stats.join(first, "label").select("label", r6(theta).alias("theta"), r6(F.least("p5", theta / 4)).alias("least"))


# -- covers


@query
def radius_join_reps(spark, d):
    return similarity.radius_join(table(spark, d, "embeddings"), "vec_id", "embedding", "label", 0.4).select("label", "src", "dst", r6("dist").alias("dist"))


def _cover(spark: SparkSession, d: str) -> DataFrame:
    """The representatives that the farthest-point cover chooses."""
    e = table(spark, d, "embeddings")
    return e.join(cover.fps(e, "vec_id", "embedding", "label", THETA).where("pick is not null").select("vec_id"), "vec_id", "left_semi")


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    return similarity.nearest_representative(table(spark, d, "embeddings"), _cover(spark, d), "vec_id", "embedding", "label").where("rank = 1")


@query
def nearest_rep_assignment(spark, d):
    return _assigned(spark, d).select("label", "vec_id", "rep", r6("dist").alias("dist"))


@query
def fps_single(spark, d):
    e = table(spark, d, "embeddings")
    return cover.fps(e, "vec_id", "embedding", "label", THETA, batch=1).where("pick is not null").select("label", "vec_id", "pick")


@query
def fps_batched(spark, d):
    return cover.fps(table(spark, d, "embeddings"), "vec_id", "embedding", "label", THETA).select("label", "vec_id", "pick", "rep", r6("cosine").alias("cosine"))


@query
def rep_merge_components(spark, d):
    merged = graph.connected_components(similarity.radius_links(_cover(spark, d), "vec_id", "embedding", "label", 0.42))
    return merged.groupBy("component").agg(F.count("*").alias("n")).select(F.col("component").alias("survivor"), "n")


@query
def coverage_metrics(spark, d):
    m = metrics.coverage(_assigned(spark, d).select("label", "dist"), "label")
    return m.select("label", "n", *(r6(c).alias(c) for c in ("coverage_mean_ani", "coverage_min_ani", "coverage_max_ani")), *(f"coverage_below_{a}" for a in (99, 98, 97, 95)))


@query
def coverage_gate(spark, d):
    best = _assigned(spark, d).select("vec_id", S.distance_to_ani(F.col("dist"), 21).alias("ani"))
    return metrics.coverage_gate(best, 95.0).select("vec_id", r6("ani").alias("ani"))


@query
def rep_diversity_pairs(spark, d):
    pairs = similarity.all_pairs(_cover(spark, d), "vec_id", "embedding", "label")
    return metrics.diversity(pairs, "label").select("label", *(r6(c).alias(c) for c in ("diversity_mean_ani", "diversity_min_ani", "diversity_max_ani")), "diversity_n_pairs")


# -- sketches


@query
def kmer_distinct_counts(spark, d):
    rows = sketch.shingle_rows(table(spark, d, "documents"), "doc_id", "text", 3)
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_shingles"))


@query
def minhash_bottom_s(spark, d):
    return sketch.bottom_sketches(table(spark, d, "documents"), "doc_id", "text", 8, 100)


@query
def oph_bins_relational(spark, d):
    return sketch.bin_minima(table(spark, d, "documents"), "doc_id", "text", 21, 256)


@query
def kmer_words_relational(spark, d):
    """Distinct canonical words of the conversations' texts, in SQL terms alone."""
    turns = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    return sketch.words_relational(turns, "id", "text", 8).groupBy("id").agg(F.countDistinct("word").alias("n_words"))


def _sketches(spark: SparkSession, d: str, **more) -> DataFrame:
    return sketch.sketch_payloads(table(spark, d, "documents"), "doc_id", "text", k=21, bins=256, kind="text", **more)


@query
def oph_sketch_vectorized(spark, d):
    return _sketches(spark, d).select("doc_id", F.md5("signature").alias("signature"), "genome_length", "n_real_bins", "n_contigs")


@query
def syncmer_sketch(spark, d):
    return _sketches(spark, d, syncmer=11).select("doc_id", F.md5("signature").alias("signature"), "n_real_bins")


@query
def oph_jaccard_pairs(spark, d):
    named = _sketches(spark, d).join(table(spark, d, "documents").select("doc_id", F.concat_ws(";", "lang", "source").alias("grp")), "doc_id")
    return sketch.sketch_pairs(named, "doc_id", "grp", over=0.05).select("grp", "a", "b", r6("jaccard").alias("jaccard"))


@query
def containment_search(spark, d):
    queries = sketch.shingle_rows(table(spark, d, "benchmark"), "item_id", "text", 3)
    targets = sketch.shingle_rows(table(spark, d, "documents"), "doc_id", "text", 3)
    return sketch.set_containment(queries, targets, "item_id", "doc_id", "shingle").where("containment >= 0.5").select("item_id", "doc_id", "common", r6("containment").alias("containment"))


@query
def countsketch_projection(spark, d):
    """What projections say of the similarity of the pairs of a language's source that are alike, beside what their sketches say."""
    sketches = written(_sketches(spark, d).select("doc_id", "signature").join(table(spark, d, "documents").select("doc_id", F.concat_ws(";", "lang", "source").alias("grp")), "doc_id"))
    rows = sketches.where("signature is not null").select("doc_id", "signature")

    def project(batches):
        for batch in batches:
            vectors = [K.count_sketch(np.frombuffer(s, "<u2"), 64) for s in batch["signature"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(vectors, pa.list_(pa.float32()))], ["doc_id", "v"])

    vectors = rows.mapInArrow(project, "doc_id long, v array<float>")
    pairs = sketch.sketch_pairs(sketches, "doc_id", "grp", over=0.05)
    side = lambda name: vectors.select(F.col("doc_id").alias(name), F.col("v").alias(f"v{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("grp", "a", "b", r6("jaccard").alias("jaccard"), r6(S.dot(F.col("va"), F.col("vb"))).alias("estimate"))


@query
def auto_calibrate_tier(spark, d):
    rows = _sketches(spark, d).orderBy(F.xxhash64("doc_id")).limit(200).select("signature").collect()
    ani, (k, bins, dim) = calibrate.calibrated_tier(np.stack([np.frombuffer(r[0], "<u2") for r in rows]), 21)
    return spark.createDataFrame([(round(ani, 4), k, bins, dim)], "ani double, k int, bins int, dim int")


@query
def nystrom_embedding(spark, d):
    """Of every document's vector the nearest of its language, with the similarity of their sketches; one without a sketch has null values."""
    sketches = _sketches(spark, d, second=True).select("doc_id", "signature", "second", F.col("n_real_bins"), F.col("doc_id").alias("accession"))
    named = written(sketches.join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id"))
    sizes = named.where("signature is not null").groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()
    out = named.where("signature is null").select("lang", "doc_id", *(F.lit(None).cast(t).alias(c) for c, t in (("dim", "int"), ("nearest", "long"), ("cosine", "double"), ("jaccard", "double"))))
    held = lambda rows, c, **to: rows.select(F.col("idx").alias(c), *(F.col(k).alias(v) for k, v in to.items()))
    for lang, n in sizes:
        rows = large.numbered(named.where(F.col("lang").eqNullSafe(F.lit(lang)) & F.col("signature").isNotNull()), "doc_id")
        vectors = large.embedded(rows, n, TEXT, own_vectors=False)
        dim = vectors.select(F.size("vector")).first()[0]
        one = vectors.withColumn("grp", F.lit(0))
        near = similarity.nearest_blocks(one, one, "idx", "vector", "grp", 1, digits=9).select("src", "dst", "cosine")
        if n == 1:  # alone it is its own nearest
            near = rows.select(F.col("idx").alias("src"), F.col("idx").alias("dst"), F.lit(-2.0).alias("cosine"))
        both = near.join(held(rows, "src", doc_id="doc_id", signature="_s"), "src").join(held(rows, "dst", doc_id="nearest", signature="_t"), "dst")
        alike = F.pandas_udf(registry.signature_jaccard, "double")("_s", "_t")
        out = out.unionByName(both.select(F.lit(lang).cast("string").alias("lang"), "doc_id", F.lit(dim).alias("dim"), "nearest", "cosine", alike.alias("jaccard")))
    return out.select("lang", "doc_id", "dim", "nearest", r6("cosine").alias("cosine"), r6("jaccard").alias("jaccard"))


@query
def certification(spark, d):
    """For every document the most similar of some hundred sampled ones of its language that certifies, by the inverted index of bins."""
    named = written(_sketches(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").where("signature is not null"))
    reps = written(cells.sampled(named, "doc_id", "lang", F.lit(100.0)).select(named.columns))
    return postings.most_similar_certified(named, reps, "doc_id", "lang", 0.95**21, 256).select("lang", "doc_id", "rep", r6("jaccard").alias("jaccard"))


# -- whole runs


@query
def tiny_cover(spark, d):
    """Greedy cover of small groups on exact word sets."""
    docs = table(spark, d, "documents").withColumn("grp", F.concat_ws(";", "lang", "source"))
    small = docs.join(docs.groupBy("grp").count().where("count <= 20").select("grp"), "grp", "left_semi")
    rows = sketch.shingle_rows(small, "doc_id", "text", 1)
    sets = small.select("grp", "doc_id").join(rows.groupBy("doc_id").agg(F.sort_array(F.collect_list("shingle")).alias("words")), "doc_id", "left")

    def choose(t: pa.Table) -> pa.Table:
        ids = t["doc_id"].to_numpy()
        order = np.argsort(ids)
        words = [set(t["words"][int(i)].as_py() or ()) for i in order]
        j = np.array([[len(a & b) / max(1, len(a | b)) for b in words] for a in words])
        reps = cover.greedy_cover(j, np.zeros(len(ids)), np.zeros(len(ids), bool), 0.5, ids[order])
        return pa.table({"grp": t["grp"][: len(reps)], "doc_id": pa.array(ids[order][reps], pa.int64()), "pick": pa.array(range(len(reps)), pa.int32())})

    return sets.groupBy("grp").applyInArrow(choose, "grp string, doc_id long, pick int")


@query
def fixed_and_singleton_routing(spark, d):
    m = manifest(spark, d).withColumn("grp", S.group_key(F.col("taxonomy"), F.col("accession")))
    fixed = m.where("lang = 'de'").groupBy("grp").agg(F.min("accession").alias("accession")).where("grp like '%s__src1'")
    return relational.routed(m, fixed, "grp").groupBy("route").agg(F.count("*").alias("n_items"), F.countDistinct("grp").alias("n_groups"))


def _derep(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    items = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("accession"), F.concat_ws(";s__", "lang", "source").alias("taxonomy"), F.col("source").alias("file"), F.col("text").alias("payload"))
    labels = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("accession"), (100.0 * F.col("quality")).alias("completeness"), F.col("toxic").cast("double").alias("contamination"), (F.col("toxic") == 0).alias("passes"), F.lit(0.5).cast("float").alias("clade_separation_score"))
    return derep(items.drop("payload"), items.select("accession", "payload"), TEXT, quality=labels.select("accession", "completeness", "contamination"), gunc=labels.select("accession", "passes", "clade_separation_score"))


@query
def derep_genomes(spark, d):
    return _derep(spark, d)["genomes_derep"].select("accession", "taxonomy", "representative", "assigned_rep", r6("ani_to_rep").alias("ani_to_rep"))


@query
def derep_results(spark, d):
    return _derep(spark, d)["results"]


@query
def derep_diversity(spark, d):
    stats = _derep(spark, d)["diversity_stats"]
    return stats.select("taxonomy", "method", "n_genomes", "n_representatives", r6("reduction_ratio").alias("reduction_ratio"), r6("coverage_mean_ani").alias("coverage_mean_ani"), "n_contaminated")


@query
def contamination_full(spark, d):
    return _derep(spark, d)["contamination_candidates"].select("taxonomy", "accession", r6("isolation_score").alias("isolation_score"), "nn_outlier", "flag_reason")


@query
def incremental_equals_full(spark, d):
    """Groups selected from two batches of arrivals, and from all at once: the rows that differ (none). The two runs go side by side."""
    items = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("accession"), F.concat_ws(";s__", "lang", "source").alias("taxonomy"), F.col("source").alias("file"), F.encode("text", "utf-8").alias("payload"), "doc_id")
    store = Store(spark, shared_folder(spark))

    def absorbed() -> DataFrame:
        for part in (0, 1):
            incremental.absorb(items.where(F.col("doc_id") % 2 == part).drop("doc_id"), store, TEXT)
        return store.read("genomes_derep").select(F.col("accession").alias("a"), F.col("representative").alias("r"), F.col("assigned_rep").alias("s"))

    with ThreadPoolExecutor(2) as pool:  # the small jobs of either leave cores to the other
        batches, whole = pool.submit(absorbed), pool.submit(derep, items.drop("payload", "doc_id"), items.select("accession", "payload"), TEXT)
        parts, full = batches.result(), whole.result()["genomes_derep"].select("accession", "taxonomy", "representative", "assigned_rep")
    same = F.coalesce((F.col("representative") == F.col("r")) & F.col("assigned_rep").eqNullSafe(F.col("s")), F.lit(False))
    both = full.join(parts, F.col("accession") == F.col("a"), "full").withColumn("taxonomy", F.coalesce("taxonomy", F.lit("absent")))
    reps = F.count_if("representative") > 0
    return both.groupBy("taxonomy").agg(F.count("accession").alias("n_full"), F.count("a").alias("n_incremental"), F.count_if(same).alias("n_same"), reps.alias("represented"))


@query
def streaming_foreach_upsert(spark, d):
    events = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    folder = shared_folder(spark)
    events.write.parquet(f"{folder}/in")
    store = Store(spark, f"{folder}/store")
    arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
    incremental.stream_upserts(arriving, store, "last_events", ["user_id"], "event_id", f"{folder}/checkpoint").awaitTermination()
    return store.read("last_events").select("user_id", "event_id", "event_type", r6("value").alias("value"))


@query
def streaming_last_row_state(spark, d):
    """The last event of each user from keyed state, its changes brought into a bucketed table by two runs over one checkpoint."""
    events = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    folder = shared_folder(spark)
    held = BucketTable(spark, f"{folder}/last", ("user_id",))
    for part in (0, 1):
        events.where(F.col("event_id") % 2 == part).write.mode("append").parquet(f"{folder}/in")
        arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
        state.upserted(state.last_rows(arriving, ["user_id"], "event_id"), held, ["user_id"], f"{folder}/checkpoint").awaitTermination()
    return held.read().select("user_id", "event_id", "event_type", r6("value").alias("value"))


@query
def sketch_store_resume(spark, d):
    """The store's sketches after two runs over one collection, with what the second run still did (nothing)."""
    items = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("accession"), F.col("lang").alias("taxonomy"), F.col("source").alias("file"), F.encode("text", "utf-8").alias("payload"))
    from . import jobs

    sketches = SketchStore(Store(spark, shared_folder(spark)), 15, 64)
    runs = [jobs.sketch(items, sketches, Config(kmer_size=15, sketch_size=64, payload_kind="text"), items) for _ in range(2)]
    return sketches.sketches().select(F.col("accession").cast("long").alias("doc_id"), "n_real_bins", F.lit(runs[0].failed).cast("long").alias("failed"), F.lit(runs[1].done).cast("long").alias("done_again"))


@query
def kmers_in_sql(spark, d):
    """Distinct words and identities by registered functions, in SQL text alone."""
    registry.register(spark)
    return spark.sql(
        """WITH w AS (SELECT d.lang, d.doc_id, k.word FROM {docs} d, LATERAL kmers(d.text, 15) k),
        n AS (SELECT lang, doc_id, count(*) AS n_words FROM w GROUP BY lang, doc_id),
        t AS (SELECT lang, count(*) AS n_docs, sum(n_words) AS n_words, min(n_words) / max(n_words) AS j FROM n GROUP BY lang),
        m AS (SELECT lang, upper_median(n_words) AS median FROM n GROUP BY lang)
        SELECT lang, n_docs, n_words, median, round(jaccard_ani(j, 15), 6) AS ani FROM t JOIN m USING (lang)""",
        docs=table(spark, d, "documents"),
    )


@query
def derep_tiny_groups(spark, d):
    """A whole run over groups by language, source and length, as far as the groups are of up to 20 items: by greedy covers of sketches."""
    docs = table(spark, d, "documents")
    grp = F.concat_ws(";s__", "lang", F.concat_ws("-", "source", F.floor(F.col("n_chars") / 400).cast("string")))
    items = docs.select(F.col("doc_id").cast("string").alias("accession"), grp.alias("taxonomy"), F.col("source").alias("file"), F.col("text").alias("payload"))
    run = derep(items.drop("payload"), items.select("accession", "payload"), replace(TEXT, sketch_size=128))
    of = run["results"].where("method in ('tiny', 'singleton')").select("taxonomy", "method")
    return run["genomes_derep"].join(of, "taxonomy").select("accession", "taxonomy", "method", "representative", "assigned_rep", r6("ani_to_rep").alias("ani_to_rep"))


@query
def derep_large_groups(spark, d):
    """Selection by language, where groups of more than 500 items are dealt to many tasks."""
    items = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("accession"), F.col("lang").alias("taxonomy"), F.col("source").alias("file"), F.col("text").alias("payload"))
    chosen = derep(items.drop("payload"), items.select("accession", "payload"), replace(TEXT, sketch_size=256, one_task=500))["genomes_derep"]
    return chosen.select("accession", "taxonomy", "representative", "assigned_rep", r6("ani_to_rep").alias("ani_to_rep"))


# -- approximate neighbours


def _cells(spark: SparkSession, d: str) -> tuple[cells.CellIndex, DataFrame]:
    rows = table(spark, d, "embeddings").withColumn("grp", F.lit(0))
    return cells.build_index(rows, "vec_id", "embedding", "grp"), rows


@query
def ann_cells(spark, d):
    """Every row's cell, and the cell's size and radius."""
    index, _ = _cells(spark, d)
    return index.rows.select("vec_id", "cell").join(index.cells.select("cell", "n", "radius"), "cell").select("vec_id", "cell", "n", r6("radius").alias("radius"))


@query
def ann_knn(spark, d):
    """The 5 nearest of all rows by the cells that a sample asks for."""
    index, rows = _cells(spark, d)
    return index.search(rows, 5, index.tuned_probes(5)).select("src", "dst", "rank", r6("dist").alias("dist"))


@query
def ann_recall(spark, d):
    """How many of the exact neighbours the index finds, and how many of all products it takes, by label."""
    index, rows = _cells(spark, d)
    probes = index.tuned_probes(5)
    exact = similarity.knn(rows, "vec_id", "embedding", "grp", 5).select("src", "dst")
    hits = written(exact.join(index.search(rows, 5, probes).select("src", "dst", F.lit(1).alias("hit")), ["src", "dst"], "left"))
    cost = index.compared(rows, probes).first()["n_compared"] / rows.count() ** 2
    found = hits.join(rows.select(F.col("vec_id").alias("src"), "label"), "src").groupBy("label").agg(F.count("*").alias("n_true"), F.count("hit").alias("n_found"))
    recall = hits.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]
    return found.select("label", "n_true", "n_found", F.lit(round(recall, 6)).alias("recall"), F.lit(probes).alias("probes"), F.lit(round(cost, 6)).alias("cost"))


@query
def ann_filtered(spark, d):
    """The 5 nearest rows of even ids, filtered before the search."""
    index, rows = _cells(spark, d)
    return index.search(rows, 5, index.tuned_probes(5), where=F.col("vec_id") % 2 == 0).select("src", "dst", "rank", r6("dist").alias("dist"))


@query
def ann_radius(spark, d):
    """All pairs within the angular radius, by the cells that can hold them, or by blocks where that is most."""
    index, _ = _cells(spark, d)
    return index.pairs_within(0.35).select("src", "dst", r6("dist").alias("dist"))
