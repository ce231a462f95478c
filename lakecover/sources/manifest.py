"""Readers of manifests and their side tables. All are lazy DataFrames over text; names of columns may vary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import canonical_accession, is_comment_or_empty, quality_score, strip_sequence_suffix

# Accepted column names, in order of preference, and places without a header.
MANIFEST_COLUMNS = {"accession": (("accession", "acc"), 0), "taxonomy": (("taxonomy", "lineage"), 1), "file": (("file", "filepath", "path"), 2)}
CHECKM2_COLUMNS = {"accession": (("name",), None), "completeness": (("completeness",), None), "contamination": (("contamination",), None)}
GUNC_COLUMNS = {
    "accession": (("genome_id", "genome"), 0), "passes": (("pass.gunc", "pass_gunc"), 8),
    "clade_separation_score": (("clade_separation_score", "css"), 6), "contamination_portion": (("contamination_portion",), 7),
}
ANI_COLUMNS = {
    "source": (("ref_file", "ref"), 0), "target": (("query_file", "query"), 1), "ani": (("ani",), 2),
    "af_ref": (("align_fraction_ref", "af_ref"), 3), "af_query": (("align_fraction_query", "af_query"), 4),
}


class DuplicateKeyError(ValueError):
    pass


def read_fields(spark: SparkSession, path: str, columns: dict, *, needs_header: bool = False) -> DataFrame:
    """Tab-separated text as trimmed string columns. The first row that isn't blank or a comment may be a header."""
    lines = spark.read.text(path).where(~is_comment_or_empty(F.col("value")))
    head = lines.limit(1).collect()
    names = [x.strip().lower() for x in head[0][0].split("\t")] if head else []
    places = {c: next((names.index(a) for a in aliases if a in names), None) for c, (aliases, _) in columns.items()}
    has_header = any(p is not None for p in places.values())
    if needs_header and head and any(p is None for p in places.values()):
        raise ValueError(f"{path}: no column for {', '.join(c for c, p in places.items() if p is None)}")
    if has_header:
        lines = lines.where(F.col("value") != head[0][0])
    at = {c: p if p is not None else default for (c, p), (_, default) in zip(places.items(), columns.values(), strict=True)}
    fields = F.split("value", "\t", -1)
    get = lambda p: F.trim(F.get(fields, F.lit(p))) if p is not None else F.lit(None).cast("string")
    return lines.select(*(get(p).alias(c) for c, p in at.items()))


def reject_duplicates(df: DataFrame, key: str) -> DataFrame:
    twice = df.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise DuplicateKeyError(f"{key} {twice[0][0]!r} occurs {twice[0][1]} times")
    return df


def read_manifest(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(accession, taxonomy, file); short rows are left out, an accession that occurs twice is an error."""
    rows = read_fields(spark, path, MANIFEST_COLUMNS).where("accession is not null and accession <> '' and taxonomy is not null and file is not null")
    return reject_duplicates(rows, "accession") if strict else rows


def read_checkm2(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(accession, completeness, contamination, quality_score) by canonical accession; rows without numbers are left out."""
    rows = read_fields(spark, path, CHECKM2_COLUMNS, needs_header=True)
    number = lambda c: F.col(c).try_cast("double")
    rows = rows.select(canonical_accession(F.col("accession")).alias("accession"), number("completeness").alias("completeness"), number("contamination").alias("contamination"))
    rows = rows.where("completeness is not null and contamination is not null")
    rows = reject_duplicates(rows, "accession") if strict else rows.dropDuplicates(["accession"])
    return rows.withColumn("quality_score", quality_score(F.col("completeness"), F.col("contamination")))


def read_gunc(spark: SparkSession, path: str) -> DataFrame:
    """(accession, passes, clade_separation_score, contamination_portion) by canonical accession without sequence suffix."""
    rows = read_fields(spark, path, GUNC_COLUMNS)
    return rows.select(
        canonical_accession(strip_sequence_suffix(F.col("accession"))).alias("accession"), F.col("passes").isin("True", "true", "1").alias("passes"),
        F.col("clade_separation_score").try_cast("float").alias("clade_separation_score"), F.col("contamination_portion").try_cast("float").alias("contamination_portion"),
    )


def read_fixed_taxa(spark: SparkSession, path: str) -> DataFrame:
    """(taxonomy, accession) by position under a header line."""
    rows = read_fields(spark, path, {"taxonomy": (("taxonomy",), 0), "accession": (("accession",), 1)})
    return reject_duplicates(rows.where("taxonomy is not null and accession is not null"), "taxonomy")


def read_list(spark: SparkSession, path: str, column: str, trim: bool = True) -> DataFrame:
    """One value per line: selected groups (trimmed, with comments) or pinned representatives (as they stand)."""
    lines = spark.read.text(path)
    value: Column = F.trim("value") if trim else F.col("value")
    return (lines.where(~is_comment_or_empty(F.col("value"))) if trim else lines.where("value <> ''")).select(value.alias(column)).distinct()


def read_ani_edges(spark: SparkSession, path: str) -> DataFrame:
    """(source, target, weight_raw, aln_frac, weight) of an ANI table: canonical order, no self pairs; weight is ANI times aligned share."""
    rows = read_fields(spark, path, ANI_COLUMNS)
    ani = F.col("ani").try_cast("double") / 100
    share = F.coalesce((F.col("af_ref").try_cast("double") + F.col("af_query").try_cast("double")) / 200, F.lit(1.0))
    return rows.where("source <> target").select(
        F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), ani.alias("weight_raw"), share.alias("aln_frac"), (ani * share).alias("weight")
    ).where("weight_raw is not null")
