"""Joins and table maintenance: every change of a table is a new DataFrame over the old one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import canonical_accession, group_key, quality_score


def attach_quality(items: DataFrame, quality: DataFrame, key: str = "accession") -> DataFrame:
    """Left join by canonical key; what has no quality scores 50."""
    q = quality.select(canonical_accession(F.col(key)).alias("_key"), "completeness", "contamination")
    joined = items.withColumn("_key", canonical_accession(F.col(key).cast("string"))).join(q, "_key", "left").drop("_key")
    return joined.withColumn("quality_score", quality_score(F.col("completeness"), F.col("contamination")))


def group_items(manifest: DataFrame) -> DataFrame:
    """(group, n) with items of unresolved species on their own, largest group first."""
    keyed = manifest.select(group_key(F.col("taxonomy"), F.col("accession")).alias("group"))
    return keyed.groupBy("group").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "group")


def pending(items: DataFrame, *done: DataFrame, key: str) -> DataFrame:
    """Items in none of the tables of finished or failed work."""
    for d in done:
        items = items.join(d.select(key).distinct(), key, "left_anti")
    return items


def ordered_fetch(keys: DataFrame, store: DataFrame, key: str, order: str) -> DataFrame:
    """Every key in order, with the store's columns or nulls and whether it is there."""
    return keys.join(store.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False))).orderBy(order)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key; of several new rows for a key any one counts."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.dropDuplicates(keys), allowMissingColumns=True)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def replace_groups(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """All rows of the groups in ``new`` give way to its rows."""
    return old.join(new.select(group).distinct(), group, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_keys(old: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return old.join(gone.select(key).distinct(), key, "left_anti")


def update_from(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns take the new table's values where it has the key and a value."""
    fresh = new.select(key, *(F.col(c).alias(f"_new_{c}") for c in columns))
    joined = old.join(fresh, key, "left")
    return joined.withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).select(old.columns)


def prune_to(rows: DataFrame, live: DataFrame, key: str) -> DataFrame:
    return rows.join(live.select(key).distinct(), key, "left_semi")


def failing(items: DataFrame, checks: DataFrame, key: str = "accession") -> DataFrame:
    """Items whose check is known and negative."""
    bad = checks.where(~F.col("passes")).select(canonical_accession(F.col(key)).alias("_key"))
    return items.withColumn("_key", canonical_accession(F.col(key).cast("string"))).join(bad, "_key", "left_semi").drop("_key")


def routed(items: DataFrame, fixed: DataFrame | None, group: str, tiny: int = 20, exact: int = 50) -> DataFrame:
    """Adds n (size of the group), fixed (its given representative or null) and route."""
    sized = items.join(items.groupBy(group).agg(F.count("*").alias("n")), group)
    sized = sized.join(fixed.select(group, F.col("accession").alias("fixed")), group, "left") if fixed is not None else sized.withColumn("fixed", F.lit(None).cast("string"))
    return sized.withColumn("route", route(F.col("n"), F.col("fixed"), tiny, exact))


def route(n: Column, fixed: Column, tiny: int = 20, exact: int = 50) -> Column:
    return F.when(fixed.isNotNull(), "fixed").when(n == 1, "singleton").when(n <= tiny, "tiny").when(n <= exact, "exact").otherwise("embedded")


def size_tiers(groups: DataFrame, n: str = "n") -> DataFrame:
    """giant, large, medium or small by where the size stands among the 95th, 75th and 25th percentile of sizes."""
    p = groups.select(F.percentile_approx(n, [0.25, 0.75, 0.95], 100_000)).first()[0] or [0, 0, 0]
    at = F.col(n)
    return groups.withColumn("tier", F.when(at > p[2], "giant").when(at > p[1], "large").when(at > p[0], "medium").otherwise("small"))
