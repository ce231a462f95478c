"""Command line: derep, sketch, pack and report."""

from __future__ import annotations

import argparse
import logging
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import group_key
from ..sources import manifest as M
from ..sources import sinks
from ..sources.stores import EmbeddingStore, PackStore, SketchStore, Store, read_manifest_payloads
from . import jobs, report
from .config import Config
from .derep import ROUTES, calibrated_run, derep

log = logging.getLogger("lakecover")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lakecover")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("derep", "sketch", "pack", "report"):
        p = commands.add_parser(name)
        p.add_argument("-o", "--store", required=True, help="folder of the run's tables")
        p.add_argument("-v", "--verbose", action="count", default=1)
        p.add_argument("-q", "--quiet", dest="verbose", action="store_const", const=0)
        if name != "report":
            p.add_argument("-t", "--manifest", required=True)
            p.add_argument("--kmer-size", type=int, default=Config.kmer_size)
            p.add_argument("--sketch-size", type=int, default=Config.sketch_size)
            p.add_argument("--syncmer-s", type=int, default=Config.syncmer_s)
        if name in ("derep", "report"):
            p.add_argument("-p", "--prefix", default="results")
            p.add_argument("--out-dir")
        if name == "derep":
            p.add_argument("-z", "--z-threshold", type=float, default=Config.z_threshold)
            p.add_argument("--ani-threshold", type=float, default=Config.ani_threshold)
            for option in ("selected-taxa", "checkm2", "gunc-scores", "fixed-taxa", "fixed-reps", "sketch-store", "pack-store", "embedding-db"):
                p.add_argument(f"--{option}")
            p.add_argument("--embedding-dim", type=int, default=Config.embedding_dim)
            p.add_argument("--diversity-threshold", type=float)
            p.add_argument("--max-rep-fraction", type=float, default=Config.max_rep_fraction)
            p.add_argument("--k-cap-max", type=int, default=Config.k_cap_max)
            p.add_argument("--nystrom-diagonal-loading", type=float, default=Config.nystrom_diagonal_loading)
            p.add_argument("--no-nystrom-degree-normalize", dest="nystrom_degree_normalize", action="store_false")
            p.add_argument("--borderline", choices=("off", "spec"), default=Config.borderline)
            p.add_argument("--one-task", type=int, default=Config.one_task, help="items of a group that one task may select")
            p.add_argument("--auto-calibrate", action="store_true", help="take sketch sizes from a sample of the items")
            p.add_argument("--require-sketches", action="store_true")
            p.add_argument("--incremental", action="store_true")
            p.add_argument("--copy-reps", action="store_true")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=(logging.ERROR, logging.INFO, logging.INFO, logging.DEBUG)[min(args.verbose, 3)])
    spark = spark or SparkSession.builder.appName("lakecover").getOrCreate()
    store = Store(spark, args.store)
    if args.command == "report":
        tables = {t: store.read(t) for t in ("results", "diversity_stats", "pipeline_stages")}
        log.info("report: %s", ", ".join(_pages(spark, args, tables)))
        return 0
    cfg = Config(**{f.name: getattr(args, f.name) for f in fields(Config) if f.name != "auto_calibrate" and getattr(args, f.name, None) is not None})
    items = M.read_manifest(spark, args.manifest)
    if args.command == "sketch":
        return jobs.sketch(items, SketchStore(store, cfg.kmer_size, cfg.sketch_size, cfg.syncmer_s), cfg).exit_code
    if args.command == "pack":
        return jobs.pack(items, PackStore(store)).exit_code
    if store.exists("pipeline_stages") and (n := store.promote_finished()):
        log.info("%d groups of older runs are complete", n)
    if args.incremental:  # stages go by group, which for an unresolved species is the item's own
        done = store.read("pipeline_stages").where("error_message is null").select(F.col("taxonomy").alias("_done"))
        items = items.withColumn("_done", group_key(F.col("taxonomy"), F.col("accession"))).join(done, "_done", "left_anti").drop("_done")
    payloads = Store(spark, args.pack_store).read("pack", PackStore.SCHEMA) if args.pack_store else read_manifest_payloads(items)
    sides = {
        "selected": args.selected_taxa and M.read_list(spark, args.selected_taxa, "taxonomy"), "quality": args.checkm2 and M.read_checkm2(spark, args.checkm2),
        "gunc": args.gunc_scores and M.read_gunc(spark, args.gunc_scores), "fixed": args.fixed_taxa and M.read_fixed_taxa(spark, args.fixed_taxa),
        "pinned": args.fixed_reps and M.read_list(spark, args.fixed_reps, "accession", trim=False),
        "sketches": SketchStore(Store(spark, args.sketch_store), cfg.kmer_size, cfg.sketch_size, cfg.syncmer_s).sketches() if args.sketch_store else None,
    }
    if args.auto_calibrate:
        cfg = calibrated_run(items, payloads, cfg)
        log.info("calibrated: k %d, %d bins, %d dimensions", cfg.kmer_size, cfg.sketch_size, cfg.embedding_dim)
    embeddings = EmbeddingStore(Store(spark, args.embedding_db)) if args.embedding_db else None
    tables = derep(items, payloads.select("accession", "payload"), cfg, embeddings, **{k: v or None for k, v in sides.items()})
    for name, rows in tables.items():
        store.append(name, rows) if name == "runs" else store.replace_groups(name, rows) if name == "stats" else store.upsert(name, rows)
    run = tables["runs"].first()
    log.info("%d items (%s): %d representatives, %d unreadable, %d failed in %.1f s", run.n_items, ", ".join(f"{getattr(run, f'n_{r}')} {r}" for r in ROUTES if getattr(run, f"n_{r}")), run.n_representatives, run.n_unreadable, run.n_failed, run.seconds)
    out = args.out_dir or args.store
    for suffix, rows in sinks.result_files({t: store.read(t) for t in tables if t != "runs"}).items():
        sinks.write_tsv(rows, f"{out}/{args.prefix}_{suffix}.tsv")
    if args.copy_reps:
        sinks.copy_representatives(store.read("genomes_derep"), payloads.join(items.select("accession", "taxonomy"), "accession") if "taxonomy" not in payloads.columns else payloads, f"{out}/representatives")
    _pages(spark, args, {t: store.read(t) for t in ("results", "diversity_stats", "pipeline_stages")})
    return 1 if store.read("jobs_failed").limit(1).count() else 0


def _pages(spark: SparkSession, args: argparse.Namespace, tables: dict[str, DataFrame]) -> list[str]:
    """Write the report; pages after the first are numbered from 2."""
    hadoop, paths = spark.sparkContext._jvm.org.apache.hadoop.fs, []
    for k, page in enumerate(report.pages(tables), 1):
        path = f"{args.out_dir or args.store}/{args.prefix}_report{f'_{k}' if k > 1 else ''}.html"
        out = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(hadoop.Path(path), True)
        out.write(bytearray(page.encode()))
        out.close()
        paths.append(path)
    return paths


if __name__ == "__main__":
    raise SystemExit(main())
