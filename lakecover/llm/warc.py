"""Operator 8: web archives of pages, with a merged capture index."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import quote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .exchange import bounded_batches, open_shared, shared_folder, write_shared, written

ARCHIVE_BYTES = 8 << 20  # of records in a file, about
RUN_BYTES, RUN_ROWS = 16 << 20, 20_000  # of payloads that a task sorts at once
RANGE_ROWS = 200_000  # captures that one merging task holds, about
BITE_BYTES = 1 << 12
BLOCK_ROWS = 1 << 10
LEAST_BYTES = 100
SALTS = 16
START = datetime(2020, 1, 1, tzinfo=UTC)
RECORDS = "urlkey string, ts string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, offset long, length long"
RECORD_NAMES = ["urlkey", "ts", "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "archive", "offset", "length"]
RECORD_KINDS = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]


def url_key(url: str) -> str:
    """Sort key of a URL: host labels from the top level down, then path and query."""
    try:
        parts = urlsplit(url)
        host = parts.hostname or ""
    except ValueError:
        return f"){url}"
    labels = host.split(".")
    if labels[0] == "www":
        labels = labels[1:]
    return ",".join(reversed(labels)) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def capture_time(page_id: int | None) -> str:
    """A page without a capture time of its own is captured as many seconds after the start as its id says."""
    try:
        return (START + timedelta(seconds=page_id or 0)).strftime("%Y-%m-%dT%H:%M:%SZ")
    except OverflowError:
        return START.strftime("%Y-%m-%dT%H:%M:%SZ")


def record_bytes(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One compressed WARC record; a revisit holds the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = "" if page_id is None else page_id
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}", f"WARC-Date: {capture_time(page_id)}", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(3, wbits=31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def records_in(file: pa.NativeFile, at: int = 0, end: int | None = None) -> Iterator[tuple[int, int, dict[str, str], dict[str, str], bytes]]:
    """(offset, length, WARC headers, HTTP headers, payload) of each record of an archive file, read as a stream: one record is held."""
    end = file.size() if end is None else end
    file.seek(at)
    rest = b""
    while at < end:
        unpacker, pieces, fed = zlib.decompressobj(wbits=31), [], 0
        while not unpacker.eof:  # in small bites: what lies behind the record is copied each time
            bite = rest[:BITE_BYTES] or file.read(1 << 20)
            rest = rest[BITE_BYTES:] if rest else b""
            if len(bite) > BITE_BYTES:
                bite, rest = bite[:BITE_BYTES], bite[BITE_BYTES:]
            if not bite:
                raise ValueError(f"cut record at {at}")
            pieces.append(unpacker.decompress(bite))
            fed += len(bite)
        length, rest = fed - len(unpacker.unused_data), unpacker.unused_data + rest
        head, _, body = b"".join(pieces).partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines)
        if not version.startswith("WARC/") or not body.endswith(b"\r\n\r\n") or len(body) != int(headers["Content-Length"]) + 4:
            raise ValueError(f"damaged record at {at}")
        http, _, payload = body[:-4].partition(b"\r\n\r\n")
        yield at, length, headers, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload
        at += length


def _page(urn: str | None) -> int | None:
    return int(urn[10:-1]) if urn and urn != "<urn:page:>" else None


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of ``pages(page_id, digest, size)`` that repeat the payload of a smaller id.

    Minima of digests are combined before they are shuffled. Only digests that occur again are
    joined back, each with its pages dealt into ``SALTS`` parts, and no payload takes part.
    """
    known = pages.where(F.col("size") >= LEAST_BYTES)
    first = known.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).drop("n")
    each = known.select("page_id", "digest", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int").alias("salt")).distinct()
    return each.join(salted, ["digest", "salt"]).where(F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))).select("page_id", "digest", F.col("first").alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record for each row of ``pages(page_id, url, html)`` to ``<archive>.warc.gz`` files of ``folder``; returns (archive, size).

    Of the rows with equal payloads of at least 100 bytes that with the smallest id is the
    response and the others revisit it. A task sorts up to ``RUN_BYTES`` of payloads by URL key,
    time and id, whatever the Arrow batches are, and writes them as one run of files of about
    ``ARCHIVE_BYTES``. A file is named by its content: a task that runs again writes the same.
    """
    bounded_batches(pages.sparkSession)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha2("html", 256))
    again = revisits(rows.select("page_id", "digest", F.octet_length("html").alias("size"))).select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to")
    rows = rows.join(again, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left").select("page_id", "url", "html", "digest", "refers_to")

    def files(run: list[tuple]) -> Iterator[tuple[str, int]]:
        bodies, size = [], 0
        run.sort(key=lambda c: c[:3])
        for n, (*_, capture) in enumerate(run):
            bodies.append(record_bytes(*capture))
            size += len(bodies[-1])
            if size >= ARCHIVE_BYTES or n == len(run) - 1:
                body = b"".join(bodies)
                name = hashlib.sha256(body).hexdigest()[:32]
                write_shared(folder, f"{name}.warc.gz", body)
                yield name, size
                bodies, size = [], 0

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, held = [], 0

        def out() -> pa.RecordBatch:
            names, sizes = zip(*files(run), strict=True)
            return pa.RecordBatch.from_pydict({"archive": pa.array(names), "size": pa.array(sizes, pa.int64())})

        for batch in batches:
            for url, page, html, digest, refers in zip(*(batch[c].to_pylist() for c in ("url", "page_id", "html", "digest", "refers_to")), strict=True):
                payload = html.encode()
                run.append((url_key(url), capture_time(page), -1 if page is None else page, (page, url, payload, digest, refers)))
                held += len(payload)
                if held >= RUN_BYTES or len(run) >= RUN_ROWS:
                    yield out()
                    run, held = [], 0
        if run:
            yield out()

    return written(rows.mapInArrow(write, "archive string, size long"))


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Every record of the files ``archives(archive, size)``, with length and digest of its full payload.

    A response's payload is hashed and must agree with its header; a revisit holds no payload, so
    its own headers tell length and digest.
    """
    spark = archives.sparkSession
    tasks = max(1, min(archives.count(), max(spark.sparkContext.defaultParallelism, -(-int(archives.agg(F.sum("size")).first()[0] or 0) // (4 * ARCHIVE_BYTES)))))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch["archive"].to_pylist():
                rows = []
                with open_shared(folder, f"{name}.warc.gz") as file:
                    for offset, length, headers, http, payload in records_in(file):
                        kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        page = _page(headers["WARC-Record-ID"])
                        if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(http["Content-Length"])):
                            raise ValueError(f"payload of page {page} has another digest")
                        rows.append((url_key(headers["WARC-Target-URI"]), headers["WARC-Date"], page, kind, _page(headers.get("WARC-Refers-To")), int(http["Content-Length"]), digest, name, offset, length))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), RECORD_KINDS, strict=True)], RECORD_NAMES)

    return archives.repartition(tasks).mapInArrow(read, RECORDS)


def lost_revisits(records: DataFrame) -> DataFrame:
    """(refers_to, payload_digest) of revisits whose response isn't among the records; distinct before they are joined."""
    asked = records.where("record_type = 'revisit'").select("refers_to", "payload_digest").distinct()
    held = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest")
    return asked.join(held, ["refers_to", "payload_digest"], "left_anti")


class LoserTree:
    """K-way merge of sorted runs: each inner node keeps the loser of its match, the winner goes up."""

    def __init__(self, runs: list[Iterator]):
        self.runs = [iter(r) for r in runs]
        self.k = len(runs)
        self.heads = [next(r, None) for r in self.runs]
        self.losers = [-1] * self.k
        self.winner = self._build(1) if self.k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x < y or (x == y and a < b))

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (a, b) if self._before(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator:
        while self.k and self.heads[self.winner] is not None:
            yield self.heads[self.winner]
            self.heads[self.winner] = next(self.runs[self.winner], None)
            at, node = self.winner, (self.winner + self.k) // 2
            while node >= 1:
                if self._before(self.losers[node], at):
                    self.losers[node], at = at, self.losers[node]
                node //= 2
            self.winner = at


def _cursor(run: pa.Table) -> Iterator[tuple]:
    """The keys of a sorted run with the row's number, a block at a time."""
    for at in range(0, run.num_rows, BLOCK_ROWS):
        block = run.slice(at, BLOCK_ROWS)
        url, ts, page, archive, offset, row = (block[c].to_pylist() for c in ("urlkey", "ts", "page_id", "archive", "offset", "row"))
        for k in range(block.num_rows):
            yield url[k], ts[k], -1 if page[k] is None else page[k], archive[k], offset[k], row[k]


def merge_index(records: DataFrame) -> DataFrame:
    """The records with their place in the global order of captures: by URL key, time, id, then archive and offset.

    Records, written once, are dealt out by ranges of that whole order, as many as hold some
    ``RANGE_ROWS`` each, so neither a host nor a page with very many captures is one task's. In a
    range the sorted runs of the archives meet in a loser tree, each read block by block. A record's
    place is that in its range and the number of records in earlier ranges.
    """
    records = written(records)
    key = ["urlkey", "ts", "page_id", "archive", "offset"]
    ranges = max(1, -(-records.count() // RANGE_ROWS))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = list(batches)
        if not tables:
            return
        table = pa.Table.from_batches(tables).combine_chunks()
        table = table.append_column("row", pa.array(range(table.num_rows), pa.int64()))
        by = table.select(["archive", "offset", "row"]).sort_by([("archive", "ascending"), ("offset", "ascending")])  # a fetch may bring blocks of a run in any order
        table = table.take(by["row"]).combine_chunks()
        table = table.set_column(table.schema.get_field_index("row"), "row", pa.array(range(table.num_rows), pa.int64()))
        names = table["archive"].combine_chunks().dictionary_encode()
        cuts = [0, *(np.flatnonzero(np.diff(names.indices.to_numpy())) + 1).tolist(), table.num_rows]
        runs = [table.slice(a, b - a) for a, b in zip(cuts, cuts[1:])]
        order = pa.array([k[-1] for k in LoserTree([_cursor(r) for r in runs])], pa.int64())
        merged = table.drop_columns(["row"]).take(order)
        part = TaskContext.get().partitionId()
        merged = merged.append_column("_range", pa.array([part] * len(order), pa.int32())).append_column("_place", pa.array(range(len(order)), pa.int64()))
        yield from merged.to_batches(max_chunksize=10_000)

    merged = written(records.repartitionByRange(ranges, *key).mapInArrow(merge, RECORDS + ", _range int, _place long"))
    sizes = merged.groupBy("_range").agg(F.count("*").alias("n"))  # a row for each range
    before = sizes.select("_range", F.coalesce(F.sum("n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return merged.join(before, "_range").withColumn("place", F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write archives, read them back, merge their index: (page_id, payload_bytes, payload_digest,
    record_type, refers_to, urlkey, ts, archive, offset, length, place), one row per input row.

    A null html is an empty payload, a null url an empty one; a null id is larger than all others.
    Rows with equal ids and payloads are all responses if theirs is the smallest id; their record
    ids are equal too, and places tell them apart. A long payload is one record, held whole by the
    task that writes or reads it. Other columns are ignored, whatever their names. An empty table
    gives an empty table.
    """
    folder = folder or shared_folder(pages.sparkSession)
    index = merge_index(read_archives(write_archives(pages, folder), folder))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "ts", "archive", "offset", "length", "place")
