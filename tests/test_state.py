"""State by key in streams, and the functions that SQL text can call."""

import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

from lakecover.functions import registry
from lakecover.functions.kernels import jaccard_16
from lakecover.operators.sketch import words_relational
from lakecover.sources.buckets import BucketTable
from lakecover.streaming import state


def test_last_rows_survive_a_restart(spark, tmp_path):
    rng, want = random.Random(2), {}
    table = BucketTable(spark, str(tmp_path / "t"), ("user",), 8)
    schema, n = "user long, at long, what string", 0
    for run in range(3):
        for part in range(2):
            rows = []
            for _ in range(40):
                n += 1
                row = (rng.choice((None, 1, 2, 3, 4)), rng.choice((n, n - 30, None)), f"r{n}")
                rows.append(row)
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            for user, at, what in rows:
                if user not in want or (at is not None and (want[user][0] is None or at > want[user][0])):
                    want[user] = (at, what)
        arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        state.upserted(state.last_rows(arriving, ["user"], "at"), table, ["user"], str(tmp_path / "checkpoint")).awaitTermination()
        got = {r.user: r.at for r in table.read().where("user is not null").collect()}
        assert got == {u: at for u, (at, _) in want.items() if u is not None}, run
    assert len(table.commits()) == 6


def test_online_cover(spark, tmp_path):
    rng = np.random.default_rng(5)
    base = {g: rng.integers(0, 60000, (3, 64)) for g in "ab"}
    rows = []
    for i in range(60):
        g = "ab"[i % 2]
        s = np.where(rng.random(64) < 0.9, base[g][i % 3], rng.integers(0, 60000, 64)).astype("<u2")
        rows.append((g, f"x{i:02}", s.tobytes()))
    for part in (rows[:30], rows[30:]):
        spark.createDataFrame(part, "grp string, accession string, signature binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        arriving = spark.readStream.schema("grp string, accession string, signature binary").parquet(str(tmp_path / "in"))
        state.upserted(state.online_cover(arriving, 0.5), BucketTable(spark, str(tmp_path / "t"), ("accession",), 4), ["accession"], str(tmp_path / "checkpoint")).awaitTermination()
    got = {r.accession: (r.representative, r.is_representative) for r in BucketTable(spark, str(tmp_path / "t"), ("accession",), 4).read().collect()}
    of = {a: np.frombuffer(s, "<u2") for _, a, s in rows}
    grp = {a: g for g, a, _ in rows}
    want, held = {}, {"a": [], "b": []}
    for _, a, _ in rows:
        near = [(jaccard_16(of[a], of[r]), r) for r in held[grp[a]]]
        best = max((j for j, _ in near), default=0)
        if best < 0.5:
            held[grp[a]].append(a)
            want[a] = (a, True)
        else:
            want[a] = (next(r for j, r in near if j == best), False)
    assert got == want and 6 <= sum(r for _, r in got.values()) < 40


def test_functions_in_sql(spark):
    assert set(registry.register(spark)) == {"jaccard_ani", "angular_distance", "signature_jaccard", "fnv1a", "upper_median", "kmers"}
    assert [r.word for r in spark.sql("SELECT word FROM kmers('', 3)").collect()] == []
    assert spark.sql("SELECT count(*) AS n FROM kmers('abcdabcd', 3)").first().n == len({r.word for r in spark.sql("SELECT word FROM kmers('abcdabcd', 3)").collect()})
    row = spark.sql("SELECT jaccard_ani(0.5D, 21) AS a, angular_distance(array(1f, 0f), array(0f, 1f)) AS d, fnv1a('a') AS f, signature_jaccard(X'01000200', X'01000200') AS j").first()
    assert row.a == pytest.approx(100 * (2 * 0.5 / 1.5) ** (1 / 21)) and row.d == pytest.approx(0.5) and row.j == 1.0
    assert spark.sql("SELECT upper_median(v) AS m FROM VALUES (1D), (5D), (3D), (NULL), (2D) t(v)").first().m == 3.0


def test_words_of_texts_in_a_lateral_join(spark):
    """Words leave Python as one array a batch of texts, not as rows; a text without words has no row."""
    registry.register(spark)
    rows = spark.createDataFrame([(1, "abcdabcd"), (2, ""), (3, None), (4, "ab1cd"), (5, "hello hello world")], "id int, text string")
    rows.createOrReplaceTempView("few_texts")
    joined = spark.sql("SELECT t.id, k.word FROM few_texts t, LATERAL kmers(t.text, 3) k")
    want = {(r.id, r.word) for r in words_relational(rows.where("length(text) >= 3"), "id", "text", 3).collect()}
    got = [(r.id, r.word) for r in joined.collect()]
    assert set(got) == want and len(got) == len(want) and {i for i, _ in got} == {1, 5}
    assert "ArrowEvalPythonUDTF" not in joined._jdf.queryExecution().executedPlan().toString()


def test_a_key_asks_its_state_once():
    calls, kept = [], {}

    class Value:
        def exists(self):
            calls.append("exists")
            return "v" in kept

        def get(self):
            calls.append("get")
            return kept.get("v")

        def update(self, row):
            calls.append("update")
            kept["v"] = row

    class Handle:
        def getValueState(self, name, schema):  # noqa: N802
            return Value()

    keep = state.LastRow(T._parse_datatype_string("user long, at long, what string"), "at")
    keep.init(Handle())
    seen = lambda *rows: [tuple(r) for r in keep.handleInputRows((1,), iter([Row("user", "at", "what")(*r) for r in rows]), None)]
    assert seen((1, None, "a"), (1, 3, "b"), (1, 2, "c")) == [(1, 3, "b")] and calls == ["get", "update"] and kept["v"] == (1, 3, "b")
    calls.clear()
    assert seen((1, 3, "d"), (1, None, "e")) == [] and calls == ["get"]
