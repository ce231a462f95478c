"""Operator 1: runs of lines that occur before, found by a suffix array over line ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import private, written

POSITION = ["doc_id", "version", "i"]


def _ranked(keys: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``rank``, which rises with ``by``: ids that grow along a range-partitioned sort, one sort for all tasks."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id())


def _classes(suffixes: DataFrame, by: list[str]) -> DataFrame:
    """The suffixes whose ``by`` others share, with the rank of their class and whether another comes first."""
    shared = suffixes.groupBy(*by).agg(F.count("*").alias("n"), F.min(F.struct(*POSITION)).alias("first")).where("n > 1").drop("n")
    ranks = _ranked(shared, by)
    return suffixes.join(ranks, by).select(*POSITION, "rank", "long", (F.col("first") < F.struct(*POSITION)).alias("later"))


def line_suffixes(lines: DataFrame) -> DataFrame:
    """Prefix doubling: (position, h, rank, later) for each suffix and each h = 1, 2, 4, ... up to its depth.

    ``lines(doc_id, version, i, one, two, long)`` holds a line's place and id. Suffixes that share
    their first h lines are one class; its rank follows the order of the line ids, so classes are
    intervals of the suffix array with a common prefix of h lines or more. A suffix stays as long as
    another shares its first h lines; all others have their final place. Each round joins a
    suffix's class with that of the suffix h lines on, sorts the distinct pairs by range, and names
    them anew. Rounds end when no class has two members: after the logarithm of the longest
    repeated run.
    """
    level, h = written(_classes(lines, ["one", "two"])), 1
    levels = level.withColumn("h", F.lit(h))
    while level.limit(1).count():
        on = level.select("doc_id", "version", (F.col("i") - h).alias("i"), F.col("rank").alias("next"))
        pairs = level.select(*POSITION, "rank", "long").join(on, POSITION).withColumnRenamed("rank", "own")
        level, h = written(_classes(pairs, ["own", "next"])), 2 * h
        levels = levels.unionByName(level.withColumn("h", F.lit(h)))
    return levels


def line_dedup(docs: DataFrame, min_lines: int = 2, long_line: int = 200) -> DataFrame:
    """Delete from ``docs(doc_id, text)`` every run of lines that occurs before, by (doc_id, place).

    A run counts from ``min_lines`` lines (a power of two), or as one line of ``long_line``
    characters. Lines are compared whole, by 128 bits of hash. Lines without a visible
    character belong to no run; a document that loses lines loses them too. What remains of two
    overlapping copies is the first in full.

    Adds n_lines (visible lines), n_removed, longest_run (lines of the longest deleted run's
    power of two) and kept_text; other columns are kept, clashing ones replaced. A null text has
    no lines and stays null; a text that loses all lines becomes empty. Repeated rows are one
    document: none deletes from the other. A long text is read whole. A null id is a document before all others. Rows with
    one id and several texts are ordered by a hash of the text. An empty table gives an empty one.
    """
    if min_lines < 1 or min_lines & (min_lines - 1):
        raise ValueError("min_lines must be a power of two")
    made = ["n_lines", "n_removed", "longest_run", "kept_text"]
    plain = docs.drop(*made)
    id_, version, own, dead = private([*plain.columns, *made], "id", "version", "lines", "gone")
    rows = plain.withColumns({
        id_: F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id")),
        version: F.coalesce(F.xxhash64("text"), F.lit(0)),
    })
    visible = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    lines = rows.select(F.col(id_).alias("doc_id"), F.col(version).alias("version"), F.posexplode(visible).alias("i", "line")).select(
        *POSITION, F.xxhash64("line").alias("one"), F.xxhash64(F.lit(7), "line").alias("two"), (F.length("line") >= long_line).alias("long"),
    )
    levels = line_suffixes(lines.dropDuplicates(POSITION))
    later = levels.where("later")
    enough = (F.col("h") == min_lines) | ((F.col("h") == 1) & F.col("long"))
    gone = (
        later.where(enough).select("doc_id", "version", F.explode(F.sequence(F.col("i"), F.col("i") + F.col("h") - 1)).alias("p"))
        .groupBy("doc_id", "version").agg(F.collect_set("p").alias(dead))
    )
    longest = later.where(F.col("h") >= min_lines).groupBy("doc_id", "version").agg(F.max("h").alias("longest_run"))
    cut = gone.join(longest, ["doc_id", "version"], "left").select(F.col("doc_id").alias(id_), F.col("version").alias(version), dead, "longest_run")
    keep = F.array_except(F.sequence(F.lit(0), F.col("n_lines").cast("int") - 1), F.col(dead))
    return (
        rows.join(cut, [id_, version], "left")
        .withColumn(own, visible)
        .withColumns({
            "n_lines": F.coalesce(F.size(own), F.lit(0)).cast("long"),
            "n_removed": F.coalesce(F.size(dead), F.lit(0)).cast("long"),
            "longest_run": F.coalesce(F.col("longest_run"), F.when(F.col(dead).isNotNull(), 1), F.lit(0)).cast("long"),
        })
        .withColumn("kept_text", F.when(F.col(dead).isNull(), F.col("text")).otherwise(F.array_join(F.transform(keep, lambda k: F.get(own, k)), "\n")))
        .drop(id_, version, own, dead)
    )
