"""Grouped statistics with the conventions of this engine: medians and percentiles are elements, never interpolated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Rank = Callable[[Column], Column]

LEAST_SPREAD = 1e-9  # Fixed value: what counts as no spread.


WINDOW_ROWS = 200_000  # Rows of a group that a window may sort in one task.
BINS = 1024
ROUNDS = 200


def _ranked_values(df: DataFrame, group: list[str], value: str, ranks: dict[str, Rank]) -> DataFrame:
    """Values at ranks by a window per group."""
    by = W.partitionBy(*group)
    ranked = df.withColumns({"_r": F.row_number().over(by.orderBy(value)) - 1, "_n": F.count(F.lit(1)).over(by)})
    return ranked.groupBy(*group).agg(*(F.max(F.when(F.col("_r") == rank(F.col("_n")), F.col(value))).alias(name) for name, rank in ranks.items()))


def _selected_values(df: DataFrame, sizes: DataFrame, group: list[str], value: str, ranks: dict[str, Rank]) -> DataFrame:
    """Values at ranks of the groups in ``sizes(group, _n)``, by narrowing the range that holds each rank.

    A round cuts the range of each (group, rank) in ``BINS`` parts of equal width, counts the
    values in each by a combining aggregation, and goes on with the part that holds the rank, until it
    holds one distinct value. Part bounds are the least and largest values in it, so rounds don't
    depend on how values lie within the range. ``sizes`` is few rows (groups larger than a bound), and so are all tables but the values.
    """
    from ..operators.checkpoints import written

    rows = df.select(*group, F.col(value).cast("double").alias("_v"))
    span = rows.join(F.broadcast(sizes), group).groupBy(*group).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.max("_n").alias("_n"))
    aims = F.explode(F.array(*(F.struct(F.lit(name).alias("_name"), rank(F.col("_n")).cast("long").alias("_rank")) for name, rank in ranks.items())))
    open_ = written(span.select(*group, "_low", "_high", aims.alias("_aim")).select(*group, "_low", "_high", "_aim.*"))
    done = None
    for _ in range(ROUNDS):
        found = open_.where("_low = _high").select(*group, "_name", F.col("_low").alias("_value"))
        done = found if done is None else done.unionByName(found)
        open_ = open_.where("_low < _high")
        if not open_.limit(1).count():
            kind = df.schema[value].dataType
            return done.groupBy(*group).agg(*(F.max(F.when(F.col("_name") == name, F.col("_value"))).cast(kind).alias(name) for name in ranks))
        inside = rows.join(F.broadcast(open_), group).where("_v between _low and _high")
        v, low, high, inf = F.col("_v"), F.col("_low"), F.col("_high"), float("inf")
        width = F.least(F.floor((v - low) / (high - low) * BINS), F.lit(BINS - 1))
        part = F.when(F.isnan(v), BINS + 1).when(v == inf, BINS).when(v == -inf, -1).when(F.isnan(high) | (high == inf) | (low == -inf), 0).otherwise(width)
        counts = inside.groupBy(*group, "_name", part.alias("_part")).agg(F.count("*").alias("_c"), F.min("_v").alias("_from"), F.max("_v").alias("_to"), F.max("_rank").alias("_rank"))
        upto = F.sum("_c").over(W.partitionBy(*group, "_name").orderBy("_part"))
        held = counts.withColumn("_upto", upto).where((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_c") <= F.col("_rank")))
        open_ = written(held.select(*group, F.col("_from").alias("_low"), F.col("_to").alias("_high"), "_name", (F.col("_rank") - F.col("_upto") + F.col("_c")).alias("_rank")))
    raise RuntimeError(f"ranks not found after {ROUNDS} rounds")


def order_statistics(df: DataFrame, group: list[str], value: str, ranks: dict[str, Rank], window_rows: int | None = None) -> DataFrame:
    """(group, names...): of each group the values at ranks from 0, each rank an expression of the group's number of values. Nulls don't count.

    Groups of up to ``window_rows`` values are sorted by a window; of larger ones no task sorts
    or holds the values, which are compared as doubles. Of those there are at most as many as the table has rows, divided by that bound.
    """
    bound = WINDOW_ROWS if window_rows is None else window_rows
    known = df.where(F.col(value).isNotNull())
    large = known.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > bound)
    few = large.collect()
    if not few:
        return _ranked_values(known, group, value, ranks)
    sizes = df.sparkSession.createDataFrame(few, large.schema)
    found = _selected_values(known, sizes, group, value, ranks)
    return _ranked_values(known.join(F.broadcast(sizes), group, "left_anti"), group, value, ranks).unionByName(found)


def group_percentiles(df: DataFrame, group: list[str], value: str, percents: tuple[int, ...] = (5, 50, 95)) -> DataFrame:
    """Truncating percentiles: the value at floor(n * p / 100)."""
    return order_statistics(df, group, value, {f"p{p}": (lambda n, p=p: F.floor(n * p / 100)) for p in percents})


def group_upper_median(df: DataFrame, group: list[str], value: str, name: str = "median") -> DataFrame:
    return order_statistics(df, group, value, {name: lambda n: F.floor(n / 2)})


def group_moments(df: DataFrame, group: list[str], value: str) -> DataFrame:
    return df.groupBy(*group).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd_pop"), F.stddev_samp(value).alias("sd_samp")
    )


def mad_threshold(df: DataFrame, group: list[str], value: str, z: float = 2.0) -> DataFrame:
    """(group, median, mad, threshold): median + z * 1.4826 * MAD; without spread median + z * IQR; without that infinity."""
    middle = order_statistics(df, group, value, {"median": lambda n: F.floor(n / 2), "q1": lambda n: F.floor(n / 4), "q3": lambda n: F.floor(n * 3 / 4)})
    spread = df.join(middle, group).withColumn("_d", F.abs(F.col(value) - F.col("median")))
    mad = group_upper_median(spread, group, "_d", "mad")
    limit = (
        F.when(F.col("mad") > LEAST_SPREAD, F.col("median") + z * 1.4826 * F.col("mad"))
        .when(F.col("q3") - F.col("q1") > LEAST_SPREAD, F.col("median") + z * (F.col("q3") - F.col("q1")))
        .otherwise(F.lit(float("inf")))
    )
    return middle.join(mad, group).select(*group, "median", "mad", limit.alias("threshold"))


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Counts of the buckets between the edges; the last bucket includes its upper edge."""
    v, last = F.col(value), len(edges) - 2
    bucket = F.lit(None).cast("int")
    for k in range(last, -1, -1):
        upper = (v <= edges[k + 1]) if k == last else (v < edges[k + 1])
        bucket = F.when((v >= edges[k]) & upper, k).otherwise(bucket)
    return df.select(bucket.alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("n"))
