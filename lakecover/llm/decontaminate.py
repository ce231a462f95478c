"""Operator 2: words of documents that occur in benchmark items."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .exchange import bounded_batches, private, written
from .text import ALNUM_SEPARATORS, Words, buffers, chunks, covered, row_sums, windows

BLOCK_BYTES = 32 << 20
_FILTER_BITS = 20


def _window(words: Words, at: int, width: int) -> bytes:
    data, start, end = words.data, words.start, words.end
    return b" ".join(data[start[k] : end[k]].tobytes() for k in range(at, at + width))


class NgramIndex:
    """Normalised windows of a bounded block of items, in arrays: less than four times the text, and a fixed filter.

    A window is a hash and the number of its first word; words lie in one text, joined by single
    spaces, so the words of any window are one slice of it.
    """

    def __init__(self, ids: list, texts: pa.Array, n: int):
        words = Words(*buffers(texts), ALNUM_SEPARATORS, lower=True)
        hashes = words.hashes()
        self.ids = [None if i is None else str(i) for i in ids]
        self.first = words.first.astype(np.int32)
        size = words.end - words.start
        self.start = np.concatenate([[0], np.cumsum(size + 1)]).astype(np.int32)
        text = np.full(int(self.start[-1]), 0x20, np.uint8)
        spots = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)
        text[spots] = words.data[covered(words.start, size, len(words.data))]
        self.text = text.tobytes()
        counts = words.counts
        width = np.repeat(np.minimum(counts, n), counts)
        self.by_width = {}
        for w in np.unique(width):
            at = np.flatnonzero((width == w) & (words.left() >= w))
            keys = windows(hashes, int(w))[at]
            by = np.argsort(keys, kind="stable")
            item = np.searchsorted(words.first, at[by], "right")
            by = by[np.append(True, (np.diff(keys[by]) != 0) | (np.diff(item) != 0))]  # once for each item
            coarse = np.zeros(1 << _FILTER_BITS, bool)
            coarse[keys >> np.uint64(64 - _FILTER_BITS)] = True
            self.by_width[int(w)] = keys[by], at[by].astype(np.int32), coarse

    def bytes_held(self) -> int:
        """Bytes of the arrays, without the filters."""
        return len(self.text) + self.start.nbytes + self.first.nbytes + sum(k.nbytes + p.nbytes for k, p, _ in self.by_width.values())

    def _items(self, window: bytes, places: np.ndarray, width: int) -> set[str] | None:
        """The items that hold the window at one of the places; None if none does."""
        same = [p for p in places if self.text[self.start[p] : self.start[p + width] - 1] == window]
        return {self.ids[i] for i in np.searchsorted(self.first, same, "right") - 1 if self.ids[i] is not None} if same else None

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
        """Start and width of every occurring window, and the items that hold it; each is compared word by word."""
        hashes, left = words.hashes(), words.left()
        starts, widths, items = [], [], []
        for width, (keys, places, coarse) in self.by_width.items():
            h = windows(hashes, width)
            at = np.flatnonzero(coarse[h >> np.uint64(64 - _FILTER_BITS)] & (left[: len(h)] >= width))
            low, high = np.searchsorted(keys, h[at]), np.searchsorted(keys, h[at], "right")
            for k in np.flatnonzero(high > low):
                held = self._items(_window(words, int(at[k]), width), places[low[k] : high[k]], width)
                if held is not None:
                    starts.append(int(at[k]))
                    widths.append(width)
                    items.append(held)
        return np.array(starts, np.int64), np.array(widths, np.int64), items


def _without(words: Words, hit: np.ndarray, text: np.ndarray) -> list[str]:
    """The texts without what lies between the first and the last word of each run of hit words."""
    n, row = len(text), words.rows()
    drop = covered(words.start[hit], (words.end - words.start)[hit], n)
    joint = np.flatnonzero(hit[:-1] & hit[1:] & (row[:-1] == row[1:])) if len(hit) else np.zeros(0, np.int64)
    drop |= covered(words.end[joint], words.start[joint + 1] - words.end[joint], n)
    at = np.concatenate([[0], np.cumsum(~drop)])[words.offsets]
    out = text[~drop].tobytes()
    return [out[i:j].decode("utf-8", "replace") for i, j in zip(at[:-1], at[1:], strict=True)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, clean: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Find the words of ``docs(doc_id, text)`` that lie in a window of ``benchmark(item_id, text)``.

    Words are runs of ASCII digits, ASCII letters in lower case and characters beyond ASCII. A
    window is ``n`` consecutive words of an item, or all its words if there are fewer. The
    windows of a block of items, at most ``block_bytes`` of text, are broadcast as a hash set in
    arrays. Items beyond one block make more blocks, scanned in turn with the rows written
    between them, so no worker holds two. A hash hit counts only if the words are equal. There
    is no shuffle.

    Returns all columns of ``docs`` but clashing ones, and n_words, n_hit, n_items,
    items_sha256 (of the item ids as strings, sorted, comma-joined), contaminated, and with
    ``clean`` clean_text: the text without the hit runs (null stays null). A null text has no
    words; an item without words has no windows; a null item id is in no list; repeated items count once. Equal rows get
    equal results. Columns of ``docs`` may have any other names. A long text is scanned whole, as
    one run of words. An empty table of either kind is allowed.
    """
    made = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "clean_text"]
    kept = docs.drop(*made)
    names = kept.columns
    spark = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (block_bytes // 2)))
    hits_, items_ = private(names, "hits", "items")
    scanned = kept.withColumns({hits_: F.lit(None).cast("binary"), items_: F.array().cast("array<string>")})
    schema = scanned.schema
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        rows = block.toArrow()
        index = spark.sparkContext.broadcast(NgramIndex(rows["item_id"].to_pylist(), rows["text"], n))

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = buffers(batch["text"])
                hits, held = batch[hits_].to_pylist(), batch[items_].to_pylist()
                for i, j in chunks(offsets):
                    words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM_SEPARATORS, lower=True)
                    start, width, found = index.value.hits(words)
                    row = np.searchsorted(words.first, start, "right") - 1
                    by = np.argsort(row, kind="stable")
                    row, start, width, found = row[by], start[by], width[by], [found[k] for k in by]
                    for r in np.unique(row):
                        own = slice(*np.searchsorted(row, [r, r + 1]))
                        spans = np.stack([start[own] - words.first[r], width[own]], 1).astype(np.int64)
                        hits[i + r] = (hits[i + r] or b"") + spans.tobytes()
                        held[i + r] = sorted(set(held[i + r]).union(*found[own]))
                columns = [pa.array(hits, pa.binary()) if c == hits_ else pa.array(held, pa.list_(pa.string())) if c == items_ else batch[c] for c in batch.schema.names]
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

        scanned = scanned.mapInArrow(scan, schema)
        if b < blocks - 1:
            scanned = written(scanned)
            index.unpersist()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch["text"])
            spans, held = batch[hits_].to_pylist(), batch[items_].to_pylist()
            n_words, n_hit, texts = [], [], []
            for i, j in chunks(offsets):
                raw = data[offsets[i] : offsets[j]]
                words = Words(raw, offsets[i : j + 1] - offsets[i], ALNUM_SEPARATORS, lower=True)
                pieces = [np.frombuffer(s, np.int64).reshape(-1, 2) + [words.first[k], 0] for k, s in enumerate(spans[i:j]) if s]
                every = np.concatenate(pieces) if pieces else np.zeros((0, 2), np.int64)
                hit = covered(every[:, 0], every[:, 1], len(words.start))
                n_words.append(words.counts)
                n_hit.append(row_sums(hit.astype(np.int64), words.first))
                if clean:
                    texts += _without(words, hit, raw)
            joined = [",".join(sorted(x)) for x in held]
            counts = np.concatenate(n_hit) if n_hit else np.zeros(0, np.int64)
            out = {c: batch[c] for c in names} | {
                "n_words": pa.array(np.concatenate(n_words) if n_words else [], pa.int64()),
                "n_hit": pa.array(counts, pa.int64()),
                "n_items": pa.array([len(x) for x in held], pa.int64()),
                "items_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in joined], pa.string()),
                "contaminated": pa.array(counts > 0, pa.bool_()),
            }
            if clean:
                out["clean_text"] = pa.array(texts, pa.string(), mask=np.asarray(batch["text"].is_null()))
            yield pa.RecordBatch.from_pydict(out)

    ddl = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" + ", clean_text string" * clean
    return scanned.mapInArrow(finish, T.StructType([*kept.schema.fields, *spark.createDataFrame([], ddl).schema.fields]))

