"""What sketches unpack at a time does not follow the size of batches."""

import pyarrow as pa

from lakecover.operators import sketch


def test_batches_are_cut_by_rows_and_bytes(monkeypatch):
    monkeypatch.setattr(sketch, "SLICE_ROWS", 10)
    monkeypatch.setattr(sketch, "SLICE_BYTES", 100)
    texts = ["x" * 5] * 25 + ["y" * 300, None, ""] + ["z" * 60] * 4
    cut = list(sketch.slices(iter([pa.RecordBatch.from_pydict({"id": list(range(32)), "t": texts}), pa.RecordBatch.from_pydict({"id": pa.array([], pa.int64()), "t": pa.array([], pa.string())})]), "t"))
    assert [t for b in cut for t in b["t"].to_pylist()] == texts
    assert all(b.num_rows <= 10 and (b.num_rows == 1 or sum(len(t or "") for t in b["t"].to_pylist()) <= 100) for b in cut)


def test_minima_and_bottom_sketches_leave_in_small_batches(spark):
    df = spark.range(3000).selectExpr("id", "concat('some words that make a sketch of ', id * 7919) AS text").coalesce(1)
    sizes = lambda rows: [r.n for r in rows.mapInArrow(lambda it: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in it), "n long").collect()]
    assert max(sizes(sketch.bottom_sketches(df, "id", "text", 8, 100))) <= 100 * sketch.SLICE_ROWS
    assert sketch.bin_minima(df, "id", "text", 21, 16).select("id").distinct().count() == 3000
