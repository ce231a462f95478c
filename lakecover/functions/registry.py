"""The engine's functions by name, for queries in SQL text."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import kernels as K


def _identity(j: pd.Series, k: int) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(j <= 0, 70.0, np.where(j >= 1, 100.0, np.clip(100 * (2 * j / (1 + j)) ** (1 / k), 70, 100)))


def jaccard_ani(j: pd.Series, k: pd.Series) -> pd.Series:
    """Percent identity of a Jaccard similarity of k-mer sets."""
    return pd.Series(_identity(j.to_numpy(float), k.to_numpy(float)))


def angular_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Angle between two unit vectors as a share of the half turn."""
    if not len(a):
        return pd.Series([], dtype=float)
    cosines = [float(np.dot(np.asarray(x, float), np.asarray(y, float))) if x is not None and y is not None else np.nan for x, y in zip(a, b, strict=True)]
    return pd.Series(np.arccos(np.clip(cosines, -1, 1)) / np.pi)


def signature_jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    """Corrected similarity of two 16-bit signatures."""
    return pd.Series([None if x is None or y is None else K.jaccard_16(np.frombuffer(x, "<u2"), np.frombuffer(y, "<u2")) for x, y in zip(a, b, strict=True)], dtype=float)


def fnv1a(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else K.fnv1a_hex(t))


def upper_median(v: pd.Series) -> float:
    """Grouped aggregate: the element at n // 2 of the sorted values; a group's values meet in one task, so large groups take ``aggregates.group_upper_median``."""
    known = np.sort(v.dropna().to_numpy(float))
    return float(known[len(known) // 2]) if len(known) else None


def kmer_words(text: pa.Array, k: pa.Array) -> pa.Array:
    """The distinct canonical words of k bases of each text, as ``words_relational`` makes them."""
    words = [K.distinct(K.canonical_kmers(K.base_codes(K.text_as_bases(t.as_py() or ""))[0], n.as_py())).view(np.int64) for t, n in zip(text, k, strict=True)]
    ends = np.cumsum([0, *(len(w) for w in words)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(words) if words else np.zeros(0, np.int64)))


#: Table function ``kmers(text, k)``: a row for each of the words, also in lateral joins. Words leave Python as arrays, so no row of them is made there.
KMERS = "CREATE OR REPLACE TEMPORARY FUNCTION kmers(text STRING, k INT) RETURNS TABLE (word BIGINT) RETURN SELECT explode(kmer_words(text, k))"

FUNCTIONS: dict[str, tuple[Callable, str]] = {
    "jaccard_ani": (jaccard_ani, "double"), "angular_distance": (angular_distance, "double"), "signature_jaccard": (signature_jaccard, "double"), "fnv1a": (fnv1a, "string"),
}


def register(spark: SparkSession) -> list[str]:
    """Registers all functions with the session; returns their names."""
    for name, (f, kind) in FUNCTIONS.items():
        spark.udf.register(name, F.pandas_udf(f, kind))
    spark.udf.register("upper_median", F.pandas_udf(upper_median, "double"))
    spark.udf.register("kmer_words", F.arrow_udf(kmer_words, "array<bigint>"))
    spark.sql(KMERS)
    return [*FUNCTIONS, "upper_median", "kmers"]
