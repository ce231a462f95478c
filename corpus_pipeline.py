"""A training corpus from raw documents, stage by stage.

Each stage takes the documents that its predecessor kept and returns documents of the same
columns; the last returns one row per copy that the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakecover.llm.decontaminate import decontaminate
from lakecover.llm.exchange import written
from lakecover.llm.jaccard import ngram_jaccard_join
from lakecover.llm.lines import line_dedup
from lakecover.llm.mixture import mix_sources
from lakecover.llm.quality import accepted_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumns({"text": F.col(text), "n_chars": F.length(text).cast("long")}).select(COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under a model of trusted text is over their language's threshold go."""
    return accepted_documents(docs, _table(spark, sf_dir, "labels")).select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines go; a document of which nothing is left goes."""
    left = line_dedup(docs, min_lines=2, long_line=200)
    return _with_text(left.where("n_removed = 0 or kept_text <> ''"), "kept_text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents linked by a Jaccard similarity of 0.8 between their 5-word shingles that with the smallest id stays."""
    groups = ngram_jaccard_join(docs, n=5, percent=80)
    later = groups.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(later, "doc_id", "left_anti").select(COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans that a benchmark item holds go; a document of which they are half the words or more goes."""
    found = decontaminate(docs.select(COLUMNS), _table(spark, sf_dir, "benchmark"), n=10, clean=True)
    return _with_text(found.where("2 * n_hit < n_words or n_hit = 0"), "clean_text")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each copy of a document that the mix takes; ``copy`` counts from 1."""
    mixed = mix_sources(docs.select(COLUMNS), weights=(3, 1, 2), share=1.5, most=2).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS, "size", "source_size", "target", "copies", "copy")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("mixing sources", mixture),
]

#: A language model has no SQL form; tests hold run() against plain versions of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
