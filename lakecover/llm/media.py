"""Operator 10: texts as images in content-addressed tar shards, described by range reads."""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import bounded_batches, open_shared, shared_folder, write_shared
from .text import buffers

UNIT = 576  # 24 x 24 samples
WIDTH = 24
SHARD_BYTES = 32 << 20
SHARD_ROWS = 50_000
HEADER_BYTES = 33  # signature and first chunk of an image
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
REFS = "array<struct<doc_id:long,n_bytes:long>>"
MEMBERS = f"shard string, offset long, length long, digest string, refs {REFS}"
TASK_BYTES = 16 << 20  # stored bytes that one reading task takes, about


def payload_of(text: bytes) -> bytes:
    """The text padded with bytes 255 to a positive multiple of the unit."""
    return text + b"\xff" * (-len(text) % UNIT if text else UNIT)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_image(payload: bytes) -> bytes:
    """A grey PNG of 24 samples a row, 8 bits each; rows are stored unfiltered."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG_SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def image_size(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from the first 33 bytes of an image."""
    if head[:8] != PNG_SIGNATURE or head[12:16] != b"IHDR" or len(head) < HEADER_BYTES:
        raise ValueError("no image header")
    return struct.unpack(">IIB", head[16:25])


def decode_image(image: bytes, width: int, height: int) -> bytes:
    """The samples of an image of ``encode_image`` whose size the header told."""
    packed, at = [], len(PNG_SIGNATURE)
    while at < len(image):
        size, kind = struct.unpack(">I4s", image[at : at + 8])
        data = image[at + 8 : at + 8 + size]
        if struct.unpack(">I", image[at + 8 + size : at + 12 + size])[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise ValueError("damaged image")
        if kind == b"IDAT":
            packed.append(data)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """64 bits, of which each says whether a 64th of the samples is brighter than the median of all 64ths."""
    means = np.frombuffer(payload, np.uint8).reshape(64, -1).mean(axis=1)
    return np.packbits(means > np.median(means)).tobytes().hex()


def _tar_header(name: str, size: int) -> bytes:
    info = tarfile.TarInfo(name)
    info.size = size
    return info.tobuf(tarfile.USTAR_FORMAT)


def write_shards(docs: DataFrame, folder: str) -> DataFrame:
    """Store each text of ``docs(doc_id, text)`` as an image in a tar file of ``folder``; returns the members as written.

    A task fills a shard up to ``SHARD_BYTES`` of images or ``SHARD_ROWS`` documents, whatever the
    Arrow batches are, and writes it as ``<shard>.tar``. A member is named by the digest of its
    bytes and a shard by those of its members, so a task that runs again writes the same file.
    Equal payloads of a shard are one member with the documents that refer to it. ``offset`` and
    ``length`` are the range of the image itself in the file.
    """
    bounded_batches(docs.sparkSession)

    def shard_of(held: dict[bytes, tuple[str, bytes, list]]) -> pa.RecordBatch:
        name = hashlib.sha256("".join(d for d, *_ in held.values()).encode()).hexdigest()[:32]
        blocks, at, rows = [], 0, []
        for digest, image, refs in held.values():
            rows.append((name, at + 512, len(image), digest, refs))
            blocks += [_tar_header(f"{digest}.png", len(image)), image, bytes(-len(image) % 512)]
            at += 512 + len(image) + -len(image) % 512
        write_shared(folder, f"{name}.tar", b"".join([*blocks, bytes(1024)]))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("doc_id", pa.int64()), ("n_bytes", pa.int64())]))]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["shard", "offset", "length", "digest", "refs"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[str, bytes, list]] = {}
        size = rows = 0
        for batch in batches:
            data, offsets = buffers(batch["text"])
            for doc_id, i, j in zip(batch["doc_id"].to_pylist(), offsets[:-1], offsets[1:], strict=True):
                text = data[i:j].tobytes()
                key = hashlib.blake2b(text, digest_size=24).digest()
                if key not in held:
                    image = encode_image(payload_of(text))
                    held[key] = hashlib.sha256(image).hexdigest(), image, []
                    size += len(image) + 1024
                held[key][2].append({"doc_id": doc_id, "n_bytes": len(text)})
                rows += 1
                if size >= SHARD_BYTES or rows >= SHARD_ROWS:
                    yield shard_of(held)
                    held, size, rows = {}, 0, 0
        if held:
            yield shard_of(held)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows.mapInArrow(store, MEMBERS).write.option("compression", "zstd").parquet(f"{folder}/members")
    return docs.sparkSession.read.schema(MEMBERS).parquet(f"{folder}/members")


def canonical_places(members: DataFrame) -> DataFrame:
    """One place of each digest: the first shard and offset that hold it. A shard names a digest once, so no digest has more rows than there are shards."""
    return members.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")


def by_shard(places: DataFrame) -> DataFrame:
    """Places dealt out by shard, some ``TASK_BYTES`` of stored bytes a task, in order of offset."""
    spark = places.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-int(places.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES))
    return places.repartition(tasks, "shard").sortWithinPartitions("shard", "offset")


def _ranges(folder: str, batch: pa.RecordBatch, most: int | None = None) -> Iterator[bytes]:
    """The stored bytes at each place of a batch, or the first ``most`` of them; a file is opened once for places in a row."""
    name, file = None, None
    for shard, offset, length in zip(*(batch[c].to_pylist() for c in ("shard", "offset", "length")), strict=True):
        if shard != name:
            name, file = shard, open_shared(folder, f"{shard}.tar")
        yield file.read_at(length if most is None else min(most, length), offset)


def media_columns(places: DataFrame, folder: str) -> DataFrame:
    """Adds width, height and bits to ``places(shard, offset, length, digest)`` by range reads of 33 bytes each."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [image_size(head) for head in _ranges(folder, batch, HEADER_BYTES)]
            made = {c: pa.array([s[k] for s in sizes], pa.int32()) for k, c in enumerate(("width", "height", "bits"))}
            yield pa.RecordBatch.from_pydict({c: batch[c] for c in ("shard", "offset", "length", "digest")} | made)

    return places.select("shard", "offset", "length", "digest").mapInArrow(read, "shard string, offset long, length long, digest string, width int, height int, bits int")


def media_features(described: DataFrame, folder: str) -> DataFrame:
    """Reads each image of ``media_columns`` back by its range, checks it against its digest and describes its samples."""
    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, shard string, offset long, length long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: dict[str, list] = {c: [] for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for image, digest, width, height in zip(_ranges(folder, batch), *(batch[c].to_pylist() for c in ("digest", "width", "height")), strict=True):
                stored = hashlib.sha256(image).hexdigest()
                if stored != digest:
                    raise ValueError(f"member {digest} has another digest")
                payload = decode_image(image, width, height)
                for c, v in zip(cols, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), stored, feature(payload)), strict=True):
                    cols[c].append(v)
            kinds = {c: pa.string() if c in ("payload_sha256", "media_sha256", "feature") else pa.int64() for c in cols}
            yield pa.RecordBatch.from_pydict({"digest": batch["digest"]} | {c: pa.array(v, kinds[c]) for c, v in cols.items()} | {c: batch[c] for c in ("width", "height", "shard", "offset", "length")})

    return described.mapInArrow(read, schema)


def media_table(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the shards, read them back: one row per row of ``docs(doc_id, text)``, in no order.

    Returns (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, width, height, digest, shard, offset, length); ``digest``, ``shard``,
    ``offset`` and ``length`` are the content address and the one place that counts for it.
    Headers of distinct payloads are read alone first and fill width and height; then each
    distinct payload is read once. Only members, never payloads, are shuffled, and a digest has
    at most one member a shard.

    A null text is an empty one; repeated rows and null ids each keep their row; equal texts get
    equal values; a long text is one member, if need be of a shard of its own; an empty table
    gives an empty one; other columns are ignored, whatever their names.
    """
    folder = folder or shared_folder(docs.sparkSession)
    members = write_shards(docs, folder)
    found = media_features(media_columns(by_shard(canonical_places(members)), folder), folder)
    held = members.select("digest", "refs").join(found, "digest")  # members meet, then each makes its rows: a text of many rows is one member a shard
    return held.withColumn("ref", F.explode("refs")).select(
        "ref.doc_id", "ref.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "digest", "shard", "offset", "length",
    )
