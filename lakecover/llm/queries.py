"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .conversations import damaged, repair_conversations
from .decontaminate import decontaminate
from .jaccard import ngram_jaccard_join
from .licenses import license_scan, notices
from .lines import line_dedup
from .media import media_table
from .merkle import FIELDS, folded, leaf_digest, merkle_manifest, proof_digest
from .mixture import mix_sources
from .quality import quality_scores
from .secrets import count_of, find_secrets, joined
from .substrings import substring_dedup
from .toxicity import fit_toxicity, held_out, toxicity
from .warc import archive_pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs, min_lines=2, long_line=200).select("doc_id", "n_lines", "n_removed", "longest_run", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, _table(spark, sf_dir, "benchmark"), n=10).drop("text")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs, weights=(3, 1, 2), share=1.5, most=2).select("doc_id", "size", "source_size", "target", "taken")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_scores(docs, _table(spark, sf_dir, "labels")).drop("version")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"))
    model = fit_toxicity(docs, _table(spark, sf_dir, "labels"), usable=~out)
    return toxicity(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"), n=5, percent=80)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan(docs, notices(spark)).drop("text")


def op8_web_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "ts", "place")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"), length=13, texts=False)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "digest", "shard", "offset", "length"]
    return media_table(_table(spark, sf_dir, "documents")).select(made)


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = {f"n_{kind}": count_of(kind) for kind in ("assign", "access", "hex")}
    return find_secrets(docs).withColumns({**counts, "base_sha256": F.sha2(joined(base=True), 256), "spans": joined(base=False)}).drop("text", "secrets")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = F.when(hit, leaf_digest(*[lower if c == "text" else F.col(c) for c in FIELDS]))
    rows = merkle_manifest(docs, tampered=tampered).withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(_table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_decontaminate": op2_decontaminate,
        "op3_mix_sources": op3_mix_sources,
        "op4_quality": op4_quality,
        "op5_toxicity": op5_toxicity,
        "op6_ngram_jaccard": op6_ngram_jaccard,
        "op7_license_scan": op7_license_scan,
        "op8_web_archive": op8_web_archive,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_media_columns": op10_media_columns,
        "op11_secret_scan": op11_secret_scan,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_conversation_repair": op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": sql.OP1,
        "op2_decontaminate": sql.OP2,
        "op3_mix_sources": sql.OP3,
        "op6_ngram_jaccard": sql.OP6,
        "op8_web_archive": sql.OP8,
        "op9_substring_dedup": sql.OP9,
        "op11_secret_scan": sql.OP11,
        "op12_merkle_manifest": sql.OP12,
        "op13_conversation_repair": sql.OP13,
    }
