"""Operator 3: how often each document is taken so that sources reach their target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .exchange import private

WORD = r"[^\x20\x09-\x0D]+"


def _size_class(size: Column) -> Column:
    """Sizes whose leading five bits agree share a class; classes ascend with size, some 16 to a doubling."""
    bits = F.length(F.bin(size))
    return F.when(size < 16, size).otherwise(bits * 16 + F.call_function("shiftright", size, (bits - 5).cast("int")) - 16).cast("int")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """Target words of each source of ``sizes(key, source_size)``.

    Sources in order of key get the weights in turn. ``share`` times all words are dealt out by
    weight; a target stops at ``most`` times its source's size and the excess goes to the rest by
    weight: sources in order of limit over weight are full as long as the level that remains
    exceeds that ratio. One row per source is ranked here, never one per document.
    """
    turn = F.pmod(F.row_number().over(W.orderBy("key")) - 1, F.lit(len(weights)))
    s = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
    s = s.withColumn("cap", (F.col("source_size") * most).cast("double"))
    order = W.orderBy(F.col("cap") / F.col("weight"), "key")
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.select(
        "*",
        F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("full"),
        F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)).alias("rest"),
        (F.sum("source_size").over(every) * share).cast("double").alias("total"),
    )
    s = s.withColumn("level", F.when((F.col("total") - F.col("full")) * F.col("weight") < F.col("cap") * F.col("rest"), (F.col("total") - F.col("full")) / F.col("rest")))
    # Beyond the first source that isn't full the level stays, so the first is the largest of none but rounding.
    first = F.first("level", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return s.select("key", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(first * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: str = "mix") -> DataFrame:
    """How many copies of each document a mix takes in which every source comes near its target words.

    Systematic sampling: within its source a document expects ``target / source_size`` copies;
    expected copies are summed up in order, a random offset of the source is added, and a
    document is taken once for each integer that its stretch crosses. Documents stand in order
    of size class, a hash of the id, size and id, so that each size is sampled at the same rate.
    The position in a source is the rows of earlier (class, hash) groups plus the rank in its
    own group, of which a source has very many: no task holds a source, however large.

    ``docs(doc_id, text, source)``; all columns but clashing ones are kept. Adds size (words; 0
    for null), source_size, target and copies, taken (= copies * size). A null source is a
    source of its own, last in order. Repeated rows count each by itself; rows of one id and size
    stand in order of a hash of their text. A source without
    words has target 0 and is not taken. The offset depends on seed and source alone: reruns
    agree. A long text counts whole. An empty table gives an empty table.
    """
    made = ["size", "source_size", "target", "copies", "taken"]
    kept = docs.drop(*made)
    key, class_, salt, place, rank = private(kept.columns, "key", "class", "salt", "at", "rank")
    rows = kept.withColumns({
        "size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
        key: F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("t")),
        salt: F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 2),
    }).withColumn(class_, _size_class(F.col("size")))
    groups = rows.groupBy(key, class_, salt).agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    classes = groups.groupBy(key, class_).agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    sources = classes.groupBy(F.col(key).alias("key")).agg(F.sum("words").alias("source_size"))
    targets = source_targets(sources, weights, share, most).withColumnRenamed("key", key)
    before = lambda *by: W.partitionBy(*by).rowsBetween(W.unboundedPreceding, -1)
    class_at = classes.select(key, class_, F.coalesce(F.sum("n").over(before(key).orderBy(class_)), F.lit(0)).alias("c"))
    group_at = groups.select(key, class_, salt, F.coalesce(F.sum("n").over(before(key, class_).orderBy(salt)), F.lit(0)).alias("g"))
    group_at = group_at.join(class_at, [key, class_]).join(targets, key).withColumn(place, F.col("c") + F.col("g")).drop("c", "g")
    order = W.partitionBy(key, class_, salt).orderBy("size", "doc_id", F.xxhash64("text"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key))), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    at = (F.col(place) + F.col(rank)).cast("double")
    copies = F.floor((at + 1) * rate + offset) - F.floor(at * rate + offset)
    return (
        rows.withColumn(rank, F.row_number().over(order) - 1).join(group_at, [key, class_, salt])
        .withColumn("copies", copies.cast("long")).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
        .drop(key, class_, salt, rank, place)
    )
