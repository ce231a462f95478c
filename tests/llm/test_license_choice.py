"""Which license is named where several templates are alike."""

import pytest

from lakecover.llm.licenses import NOTICES, license_scan, notices

GNU = "This work is licensed under the GNU General Public License, version 3."
CASES = [
    ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
    ("Licensed under CC BY-ND 4.0.", ""),
    ("Licensed under CC BY-NC-SA 4.0.", ""),
    (GNU, "GPL-3.0"),
    (GNU.replace("version 3", "version 2"), ""),
    (GNU.replace("GNU", "GNU Lesser"), ""),
    ("Licensed under the Apache License, Version 1.1.", ""),
    ("Licensed and published, licensed under CC BY 4.0.", "CC-BY-4.0"),
    (f"{NOTICES['MIT-permission'].replace(' free of charge', ' free of charge 12')} All rights reserved.", "MIT-permission,all-rights-reserved"),
    ("Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0.", "CC-BY-4.0,CC-BY-NC-4.0"),
]


@pytest.mark.parametrize("blocks", [1 << 20, 100])
def test_one_license_is_named_and_no_like_one(spark, blocks):
    rows = [(i, f"some words before. {text} And some after.") for i, (text, _) in enumerate(CASES)]
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string"), notices(spark), block_bytes=blocks).collect()}
    assert [(text, got[i].licenses) for i, (text, _) in enumerate(CASES)] == CASES
    assert all(got[i].n_matches == len(list(filter(None, want.split(",")))) for i, (_, want) in enumerate(CASES))


def test_the_longer_template_wins(spark):
    templates = spark.createDataFrame([("part", "one two three four five"), ("whole", "zero one two three four five six"), ("again", "one two three four five")], "template_id string, text string")
    docs = spark.createDataFrame([(1, "zero one two three four five six"), (2, "x one two three four five y")], "doc_id long, text string")
    assert {r.doc_id: r.licenses for r in license_scan(docs, templates).collect()} == {1: "whole", 2: "again"}
