"""Thresholds of the quality model come from trusted texts that it has not counted."""

import pytest

from lakecover.llm.quality import quality_scores

ODD = "Zyx wvut, srqp onml kjih gfed cba qqq."


@pytest.fixture(scope="module")
def texts(spark):
    nouns, verbs = ("cat", "dog", "bird", "child"), ("sees", "likes", "hears", "finds")
    rows = [(i, f"The {nouns[i % 4]} {verbs[i // 4 % 4]} the {nouns[i // 16 % 4]} and the mat number {i}.", "en") for i in range(64)]
    return spark.createDataFrame([*rows, (64, ODD, "en")], "doc_id long, text string, lang string").repartition(3)


def labelled(spark, ids):
    return spark.createDataFrame([(i, 1) for i in ids], "doc_id long, quality int")


def test_threshold_is_the_quantile_of_the_trusted(spark, texts):
    got = quality_scores(texts, labelled(spark, range(64)), quantile=0.5).collect()
    trusted = sorted(r.adjusted for r in got if r.doc_id < 64)
    assert {r.threshold for r in got} == {trusted[31]}
    assert sum(x <= trusted[31] for x in trusted) == sum(r.accepted for r in got)


def test_a_text_does_not_count_for_itself(spark, texts):
    with_it, without = (next(r.perplexity for r in quality_scores(texts, labelled(spark, range(n))).collect() if r.doc_id == 64) for n in (65, 64))
    assert with_it == pytest.approx(without)


def test_few_labelled_junk_texts_pass(spark, sample):
    docs, labels = (spark.read.parquet(f"{sample.replace('sf0.001', 'sf0.01')}/{name}.parquet") for name in ("documents", "labels"))
    got = {r.quality: r for r in quality_scores(docs, labels).join(labels, "doc_id").groupBy("quality").agg({"*": "count", "accepted": "count_if"}).collect()}
    share = {q: r["count_if(accepted)"] / r["count(1)"] for q, r in got.items()}
    assert share[0] <= 0.1 and share[1] >= 0.98
