"""Distributed plumbing shared by the operators.

*Parts* are bounded runs of documents (by id order or by hash). A part asks a
sharded index about its distinct 64-bit keys in packed blobs and gets packed
answers back. A key is sent once per part however often it occurs there, so no
hot key reaches a shard more often than there are parts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import checkpoints
from ..operators.checkpoints import give_back, let_go, shared_folder
from ..operators.graph import connected_components

__all__ = ["BLOB", "blob_table", "bounded_batches", "connected_components", "let_go", "open_shared", "pack_shards", "part_count", "private", "shared_folder", "squeezed", "text_bytes", "unsqueezed", "write_shared", "written"]

PART_BYTES = 12 << 20  # of text
BATCH_BYTES, BATCH_ROWS = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 8 MB and 2,000 rows: what a Python worker holds of the texts at once, in and out.

    Plans read these settings when they run, so they stay; a value that the session was given
    itself is left alone. No result depends on them.
    """
    given = spark._jsparkSession.sessionState().conf()
    for key, value in ((BATCH_BYTES, "8m"), (BATCH_ROWS, "2000")):
        if not given.contains(key):
            spark.conf.set(key, value)


def written(df: DataFrame) -> DataFrame:
    """``checkpoints.written``, after which the driver gives back what planning took outside its heap."""
    out = checkpoints.written(df)
    give_back(df.sparkSession)
    return out


def private(columns: Iterable[str], *names: str) -> list[str]:
    """For each name one like it that none of the columns has, whatever their case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while (name := f"_{name}") in taken:
            pass
        out.append(name)
    return out


def _location(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def write_shared(folder: str, name: str, body: bytes) -> None:
    """Write a file of the shared folder at once: under a name of its own first, so that no reader sees half of it."""
    files, path = _location(folder)
    files.create_dir(path, recursive=True)
    draft = f"{path}/.{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(draft, compression=None) as out:
        out.write(body)
    files.move(draft, f"{path}/{name}")


def open_shared(folder: str, name: str) -> pa.NativeFile:
    """A file of the shared folder for range reads."""
    files, path = _location(folder)
    return files.open_input_file(f"{path}/{name}")


def text_bytes(df: DataFrame) -> int:
    """Bytes of all texts and ids, measured: the size of compressed files says little about repetitive texts."""
    return int(df.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)).first()[0] or 0)


def part_count(df: DataFrame, size: int, part_bytes: int = PART_BYTES) -> int:
    """Number of parts for ``size`` bytes of text: no part grows with the input; at least the session's shuffle partitions."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))


def squeezed(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with a string column as its compressed UTF-8 bytes, null staying null: texts cross a shuffle at less than half their size."""
    schema = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == text else f for f in df.schema.fields])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = pa.array([None if t is None else packer.compress(t) for t in batch[text].cast(pa.large_binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([packed if c == text else batch[c] for c in batch.schema.names], batch.schema.names)

    return df.mapInArrow(pack, schema)


def unsqueezed(table: pa.Table, text: str = "text") -> pa.Table:
    """The table with the texts of ``squeezed`` as bytes."""
    opener = zstandard.ZstdDecompressor()
    texts = pa.array([None if z is None else opener.decompress(z) for z in table[text].to_pylist()], pa.large_binary())
    return table.set_column(table.schema.get_field_index(text), text, texts)


def pack_shards(keys: np.ndarray, shards: int) -> list[tuple[int, int, int]]:
    """Slices (shard, from, to) of sorted 64-bit keys; a shard is a range of keys."""
    shard = ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    at = np.flatnonzero(np.diff(shard, prepend=np.uint64(shards + 1)))
    return [(int(shard[i]), int(i), int(j)) for i, j in zip(at, [*at[1:], len(keys)], strict=True)] if len(keys) else []


BLOB = T.StructType([
    T.StructField("shard", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("blob", T.BinaryType()),
])


def blob_table(rows: list[tuple[int, int, bytes]], names: tuple[str, str] = ("shard", "part")) -> pa.Table:
    a, b, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({names[0]: pa.array(a, pa.int32()), names[1]: pa.array(b, pa.int32()), "blob": pa.array(blob, pa.binary())})
