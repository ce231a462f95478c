"""Exact order statistics of groups that no task holds."""

import random

import pytest
from pyspark.sql import functions as F

from lakecover.functions import aggregates as A

PERCENTS = (0, 5, 25, 50, 75, 95)


def plain(rows):
    out = {}
    for g in {g for g, _ in rows}:
        v = sorted((x for k, x in rows if k == g and x is not None), key=lambda x: (x != x, x))
        if v:
            out[g] = tuple(v[len(v) * p // 100] for p in PERCENTS)
    return out


def values(seed):
    rng = random.Random(seed)
    rows = [("one", rng.random()) for _ in range(900)] + [("ties", float(rng.randrange(4))) for _ in range(700)] + [("wide", rng.choice((1e-300, 1e300, -1e30, 3.0)) * rng.random()) for _ in range(500)]
    rows += [("same", 7.0)] * 400 + [("odd", rng.choice((float("inf"), float("-inf"), 1.0, 2.0, None))) for _ in range(300)] + [("few", 1.5), ("few", 0.5), ("none", None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("bound", [0, 450, 10**6])
def test_percentiles_at_any_bound(spark, bound, monkeypatch):
    monkeypatch.setattr(A, "WINDOW_ROWS", bound)
    rows = values(bound)
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r.g: tuple(r[1:]) for r in A.group_percentiles(df, ["g"], "v", PERCENTS).collect()}
    assert got == plain(rows)


def test_integers_keep_their_type_and_large_groups_meet_no_window(spark, monkeypatch):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 5000).alias("v"))
    want = sorted(map(tuple, A.group_upper_median(df, ["g"], "v").collect()))
    monkeypatch.setattr(A, "WINDOW_ROWS", 100)
    got = A.group_upper_median(df, ["g"], "v")
    assert sorted(map(tuple, got.collect())) == want and dict(got.dtypes)["median"] == "bigint"
    limits = A.mad_threshold(df, ["g"], "v").collect()
    monkeypatch.setattr(A, "WINDOW_ROWS", 10**6)
    assert sorted(map(tuple, limits)) == sorted(map(tuple, A.mad_threshold(df, ["g"], "v").collect()))
