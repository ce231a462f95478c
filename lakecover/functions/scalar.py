"""Scalar and array functions as Column expressions: all stay inside whole-stage codegen or Catalyst."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ANI_FLOOR, ANI_CEILING = 70.0, 100.0


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


# -- strings


def canonical_accession(name: Column) -> Column:
    """The accession without one leading database prefix."""
    return F.regexp_replace(name, "^(RS_|GB_)", "")


def strip_sequence_suffix(name: Column) -> Column:
    return F.regexp_replace(name, r"\.(fna|fa|fasta)\.gz$|\.(fna|fa|fasta)$", "")


def path_stem(path: Column) -> Column:
    """File name without folder, sequence suffixes and a trailing ``_genomic``."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_replace(F.regexp_replace(name, r"\.(gz|zst)$", ""), r"(_genomic)?\.(fna|fa|fasta)$|_genomic$", "")


def has_empty_species(lineage: Column) -> Column:
    """Whether the lineage ends in a species rank without a name."""
    return lineage.rlike(r";s__[ \t]*$")


def group_key(lineage: Column, accession: Column) -> Column:
    """Items of one species share a group; an item of unresolved species is a group of its own."""
    return F.when(has_empty_species(lineage), F.concat_ws("#", lineage, accession)).otherwise(lineage)


def lineage_field(lineage: Column, rank: str) -> Column:
    return F.regexp_extract(lineage, rf"(?:^|;){rank}__([^;]*)", 1)


def is_comment_or_empty(line: Column) -> Column:
    trimmed = F.trim(line)
    return (trimmed == "") | trimmed.startswith("#")


# -- quality


def quality_score(completeness: Column, contamination: Column) -> Column:
    """Completeness less five times contamination; 50 where either is unknown."""
    return F.coalesce(completeness - 5 * contamination, F.lit(50.0))


def adhoc_quality(quality: Column, n_real_bins: Column, bins: int, excluded: Column) -> Column:
    """An unknown quality (50) becomes the filled share of the sketch in percent, between 1 and 99."""
    unknown = (F.abs(quality - 50) <= 0.01) & ~excluded
    return F.when(unknown, clamp(100.0 * n_real_bins / bins, 1.0, 99.0)).otherwise(quality)


# -- distances


def dot(a: Column, b: Column) -> Column:
    """Inner product of two float arrays, summed in double."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def angular_distance_of(cosine: Column) -> Column:
    return F.acos(clamp(cosine, -1.0, 1.0)) / math.pi


def angular_distance(a: Column, b: Column) -> Column:
    return angular_distance_of(dot(a, b))


def euclidean_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def _identity(j: Column, k: int) -> Column:
    return F.pow(2 * j / (1 + j), F.lit(1.0 / k))


def jaccard_to_ani(j: Column, k: int) -> Column:
    """Percent identity of a Jaccard similarity of k-mer sets, between 70 and 100."""
    return F.when(j <= 0, ANI_FLOOR).when(j >= 1, ANI_CEILING).otherwise(clamp(100 * _identity(j, k), ANI_FLOOR, ANI_CEILING))


def jaccard_to_ani_fraction(j: Column, k: int) -> Column:
    return F.when(j <= 0, 0.0).when(j >= 1, 1.0).otherwise(_identity(j, k))


def distance_to_ani(d: Column, k: int) -> Column:
    """Percent identity of an angular distance: its cosine is the Jaccard similarity."""
    return F.when(d <= 0, ANI_CEILING).when(d >= 0.5, ANI_FLOOR).otherwise(jaccard_to_ani(F.cos(d * math.pi), k))


def ani_to_jaccard(ani_fraction: Column, k: int) -> Column:
    q = F.pow(ani_fraction, F.lit(float(k)))
    return q / (2 - q)


def ani_to_theta(ani_fraction: Column, k: int) -> Column:
    return F.acos(clamp(ani_to_jaccard(ani_fraction, k), -1.0, 1.0)) / math.pi


def mash_distance(j: Column, k: int) -> Column:
    return F.when(j <= 0, 1.0).when(j >= 1, 0.0).otherwise(clamp(-F.log(2 * j / (1 + j)) / k, 0.0, 1.0))


def corrected_jaccard(matches: Column, bins: Column) -> Column:
    """Share of equal 16-bit bins without those expected by chance, not below 0."""
    chance = 2.0**-16
    return F.greatest(F.lit(0.0), (matches / bins - chance) / (1 - chance))


# -- statistics


def zscore(x: Column, mean: Column, sd: Column) -> Column:
    return F.when(sd > 1e-9, (x - mean) / sd).otherwise(0.0)


def upper_median(sorted_values: Column) -> Column:
    """The element at floor(n / 2) of an ascending array."""
    return F.get(sorted_values, F.floor(F.size(sorted_values) / 2).cast("int"))


def truncating_percentile(sorted_values: Column, percent: int) -> Column:
    """The element at floor(n * percent / 100) of an ascending array."""
    return F.get(sorted_values, F.floor(F.size(sorted_values) * percent / 100).cast("int"))


def flag_reason(size_z: Column, diversity_z: Column, contigs: Column, z: float) -> Column:
    """Why an item is flagged: the outlier itself, then what marks its kind."""
    base = F.when(F.abs(size_z) > z, "nn_outlier+size_outlier").otherwise("nn_outlier")
    marks = (F.when(diversity_z > 3, ":kmer_diverse").otherwise(""), F.when(size_z < -2, ":small_genome").otherwise(""), F.when(contigs > 100, ":fragmented").otherwise(""))
    return F.concat(base, *marks)


def reduction_ratio(representatives: Column, items: Column) -> Column:
    return 1 - representatives / items


def canonical_edge(edge: dict[str, Column]) -> dict[str, Column]:
    """source and target in order, with their lengths."""
    swap = edge["source"] > edge["target"]
    pick = lambda a, b: F.when(swap, edge[b]).otherwise(edge[a])
    return edge | {
        "source": pick("source", "target"), "target": pick("target", "source"),
        "source_length": pick("source_length", "target_length"), "target_length": pick("target_length", "source_length"),
    }


def human_count(n: Column) -> Column:
    return F.format_number(n, 0)


def human_duration(seconds: Column) -> Column:
    whole = seconds.cast("long")
    h, m, s = F.floor(whole / 3600), F.floor(F.pmod(whole, F.lit(3600)) / 60), F.pmod(whole, F.lit(60))
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, s)).when(m > 0, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%ds", s))
