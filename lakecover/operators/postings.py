"""Pairs of sketches that certify, found by an inverted index over (bin, value): no group is one task, and few pairs are compared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .certify import _certified_rows, row_jaccard

CHANCE = 2.0**-16


def tokens(sketches: DataFrame, id: str, group: str, bins: int) -> DataFrame:
    """(group, id, token): of every bin its number and 16-bit value as one number."""
    schema = T.StructType([sketches.schema[group], sketches.schema[id], T.StructField("tokens", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.arange(bins, dtype=np.int64) << 16
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                values = np.stack([np.frombuffer(s, "<u2") for s in part["signature"].to_pylist()]).astype(np.int64) | base
                flat = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), bins).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part[group], part[id], flat], [group, id, "tokens"])

    return sketches.select(group, id, "signature").mapInArrow(run, schema).select(group, id, F.explode("tokens").alias("token"))


def candidates(items: DataFrame, reps: DataFrame, id: str, group: str, q: float, bins: int) -> DataFrame:
    """(group, id, rep) of all pairs that may certify.

    A pair that certifies has some number L of equal bins at least: by similarity a share of all, or
    by containment a share of the fewer real bins. Of an item's tokens that a representative of its group has, the
    L - 1 most frequent may go unseen: each such pair has another. So frequent tokens are cut off
    without a pair being lost.
    """
    share = q / (2 - q) * (1 - CHANCE) + CHANCE
    held = tokens(reps, id, group, bins).withColumnRenamed(id, "rep")
    often = held.groupBy(group, "token").agg(F.count("*").alias("_often"))
    fewest = reps.groupBy(group).agg(F.min("n_real_bins").alias("_fewest"))
    least = items.select(group, id, "n_real_bins").join(fewest, group).select(
        group, id, F.greatest(F.lit(1), F.least(F.lit(int(np.ceil(share * bins - 1e-9))), F.ceil(q * F.least("n_real_bins", "_fewest") - 1e-9))).alias("_least"),
    )
    by = W.partitionBy(group, id)
    met = tokens(items, id, group, bins).join(often, [group, "token"]).withColumns({"_place": F.row_number().over(by.orderBy("_often", "token")), "_all": F.count("*").over(by)})
    kept = met.join(least, [group, id]).where(F.col("_place") <= F.col("_all") - F.col("_least") + 1).select(group, id, "token")
    return kept.join(held, [group, "token"]).where(F.col(id) != F.col("rep")).select(group, id, "rep").distinct()


def compared(pairs: DataFrame, items: DataFrame, reps: DataFrame, id: str, group: str, q: float, bins: int) -> DataFrame:
    """(group, id, rep, jaccard, certified) of ``pairs(group, id, rep)``, from the sketches themselves."""
    side = lambda df, name, tag: df.select(F.col(group), F.col(id).alias(name), F.col("signature").alias(f"_s{tag}"), F.col("real").alias(f"_r{tag}"))
    both = pairs.join(side(items, id, 1), [group, id]).join(side(reps, "rep", 2), [group, "rep"])
    kinds = both.schema
    made = T.StructType([kinds[group], kinds[id], kinds["rep"], T.StructField("jaccard", T.DoubleType()), T.StructField("certified", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                n = part.num_rows
                sig = np.stack([np.frombuffer(s, "<u2") for c in ("_s1", "_s2") for s in part[c].to_pylist()])
                real = np.stack([np.unpackbits(np.frombuffer(r, np.uint8), count=bins, bitorder="little").astype(bool) for c in ("_r1", "_r2") for r in part[c].to_pylist()])
                own, other = np.arange(n), np.arange(n, 2 * n)
                j = row_jaccard(sig, np.concatenate([other, own]))[:n]
                yield pa.RecordBatch.from_arrays([part[group], part[id], part["rep"], pa.array(j), pa.array(_certified_rows(sig, real, other, own, q))], made.names)

    return both.select(group, id, "rep", "_s1", "_r1", "_s2", "_r2").mapInArrow(run, made)


def most_similar_certified(items: DataFrame, reps: DataFrame, id: str, group: str, q: float, bins: int) -> DataFrame:
    """(group, id, rep, jaccard): for each of ``items`` the most similar other row of ``reps`` that certifies, of equal ones the smaller id; null without one.

    Both are ``(group, id, signature, real, n_real_bins)``.
    """
    pairs = compared(candidates(items, reps, id, group, q, bins), items, reps, id, group, q, bins).where("certified")
    by = W.partitionBy(group, id).orderBy(F.desc("jaccard"), "rep")
    best = pairs.withColumn("_place", F.row_number().over(by)).where("_place = 1").select(group, id, "rep", "jaccard")
    return items.select(group, id).join(best, [group, id], "left")
