"""License scans against a plain alignment of every template with every place."""

import re
from collections import Counter

import numpy as np
import pytest

from lakecover.llm.licenses import NOTICES, banded_alignment, license_scan, notices, winnowed

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def lcs(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, best[j + 1] = best[j + 1], last + 1 if x == y else max(best[j + 1], best[j])
    return best[-1]


def test_notices_are_found_whole_changed_and_not_elsewhere(spark):
    filler = " ".join(f"w{i}" for i in range(50))
    rows = [(i, f"{filler}\n{t}\n{filler}") for i, t in enumerate(NOTICES.values())]
    rows += [(100, NOTICES["MIT-permission"].replace("hereby ", "").replace("person", "body").upper()), (101, filler), (102, None), (103, ""), (104, f"{NOTICES['Apache-2.0']} {filler} {NOTICES['Apache-2.0']}"), (104, "All rights")]
    got = license_scan(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as licenses"), notices(spark)).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.text): r for r in got}
    for i, (name, text) in enumerate(NOTICES.items()):
        r = by[i, rows[i][1]]
        assert name in r.licenses.split(",") and r.best_coverage == 1 and f"{name}:50-{50 + len(WORD.findall(text.lower()))}" in r.spans.split(",")
    assert by[100, rows[len(NOTICES)][1]].licenses == "MIT-permission" and 0.8 < by[100, rows[len(NOTICES)][1]].best_coverage < 1
    assert all(r.n_matches == 0 and r.licenses == "" for r in got if r.doc_id in (101, 102, 103))
    assert {r.n_matches for r in got if r.doc_id == 104} == {0, 2}


@pytest.mark.parametrize("blocks", [1 << 20, 100])
def test_blocks_and_plain_coverage(spark, blocks, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: set(filter(None, r.licenses.split(","))) for r in license_scan(docs, notices(spark), block_bytes=blocks).collect()}
    for d, text in docs.collect():
        words = WORD.findall(text.translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})))
        for name, notice in NOTICES.items():
            t = WORD.findall(notice.lower())
            if any(words[i : i + len(t)] == t for i in range(len(words))):
                assert name in got[d]
        for name in got[d]:
            assert lcs(WORD.findall(NOTICES[name].lower()), words) >= 0.8 * len(WORD.findall(NOTICES[name].lower()))


def test_alignment_is_the_longest_common_subsequence():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = rng.integers(0, 4, 12), rng.integers(0, 4, 15)
        path = banded_alignment(a, b, 0, 20)
        assert len(path) == lcs(a.tolist(), b.tolist()) and path == sorted(set(path))


def test_winnowing_keeps_one_of_every_window():
    h = np.random.default_rng(1).integers(0, 50, 200).astype(np.uint64)
    kept = set(winnowed(h, np.array([0, 120, 121, 121, 200]), 4).tolist())
    assert all(kept & set(range(i, i + 4)) for a, b in ((0, 120), (121, 200)) for i in range(a, b - 3)) and 120 in kept


def test_nothing(spark, empty):
    assert license_scan(empty, notices(spark)).count() == 0
    none = spark.createDataFrame([], "template_id string, text string")
    assert Counter(r.n_matches for r in license_scan(spark.createDataFrame([(1, "a")], "doc_id long, text string"), none).collect()) == {0: 1}


def test_columns_of_any_name_are_kept(spark):
    docs = spark.createDataFrame([(1, "Licensed under CC BY-SA 4.0.", "a"), (2, None, "b")], "doc_id long, text string, _found string")
    got = {r.doc_id: r for r in license_scan(docs, notices(spark)).collect()}
    assert got[1]["_found"] == "a" and got[2]["_found"] == "b" and got[1].n_matches == 1 and got[2].n_words == 0
