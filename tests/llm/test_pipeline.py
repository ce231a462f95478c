"""The corpus pipeline against plain versions of its stages, on the documents each stage is given."""

from collections import Counter

import pytest
from test_operators import plain_decontamination, plain_jaccard, plain_lines

import corpus_pipeline
from lakecover.llm.exchange import written


@pytest.fixture(scope="module")
def steps(spark, sample):
    docs = [spark.read.parquet(f"{sample}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(written(stage(spark, docs[-1], sample)))
    return [d.toPandas() for d in docs]


def pairs(df):
    return list(zip(df.doc_id.tolist(), df.text.tolist(), strict=True))


def test_stages_keep_the_columns(steps):
    assert all(list(d.columns) == corpus_pipeline.COLUMNS for d in steps[:-1])
    assert all((d.n_chars == d.text.str.len()).all() for d in steps[2:])


def test_quality_stage_keeps_clean_text(steps, spark, sample):
    labels = spark.read.parquet(f"{sample}/labels.parquet").toPandas().set_index("doc_id").quality
    kept = set(steps[1].doc_id)
    good, bad = (set(labels[labels == q].index) for q in (1, 0))
    assert len(good & kept) >= 0.95 * len(good) and len(bad & kept) <= 0.4 * len(bad)
    before = dict(pairs(steps[0]))
    assert all(before[d] == t for d, t in pairs(steps[1]))


def test_line_stage(steps):
    want = Counter((d, k) for d, _, gone, k in plain_lines(pairs(steps[1])) if not gone or k)
    assert Counter(pairs(steps[2])) == want


def test_near_duplicate_stage(steps):
    want = {d for d, _, c in plain_jaccard(pairs(steps[2])) if c == d}
    assert set(steps[3].doc_id) == want


def test_decontamination_stage(steps, spark, sample):
    items = [tuple(r) for r in spark.read.parquet(f"{sample}/benchmark.parquet").select("item_id", "text").collect()]
    found = plain_decontamination(pairs(steps[3]), items)
    assert set(steps[4].doc_id) == {d for d, n, hit, *_ in found if not hit or 2 * hit < n}
    assert not any(hit for _, _, hit, *_ in plain_decontamination(pairs(steps[4]), items))


def test_mixture_stage(steps):
    last = steps[5]
    per = last.groupby("doc_id").agg(n=("copy", "size"), c=("copies", "first"), s=("size", "first"))
    assert (per.n == per.c).all() and per.n.max() <= 2
    by = last.groupby("source").agg(t=("size", "sum"), g=("target", "first"))
    assert (abs(by.t - by.g) <= 2 * steps[4].n_chars.max()).all()


def test_run_is_the_stages_in_turn(steps, spark, sample):
    got = corpus_pipeline.run(spark, sample).toPandas()
    key = lambda d: Counter(map(tuple, d[["doc_id", "copy", "text"]].itertuples(index=False)))
    assert key(got) == key(steps[-1])
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and corpus_pipeline.ORACLE_SQL is None
