"""Operator 9: removal of passages that an earlier document also holds."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import BLOB, blob_table, bounded_batches, pack_shards, part_count, squeezed, text_bytes, unsqueezed
from .text import SPACE_SEPARATORS, Words, buffers, chunks, covered, row_sums, windows

PERIOD = 7
COVER = (1, 2, 4)  # each difference modulo 7 is a difference of two of these


def _in_cover(words: Words) -> np.ndarray:
    at = np.arange(len(words.start)) - np.repeat(words.first[:-1], words.counts)
    return np.isin(at % PERIOD, COVER)


def _groups_with_two(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order; position of each key among them; whether two owners have the key."""
    distinct, inverse = np.unique(keys, return_inverse=True)
    low = np.full(len(distinct), np.iinfo(np.int64).max)
    high = np.full(len(distinct), np.iinfo(np.int64).min)
    np.minimum.at(low, inverse, owner)
    np.maximum.at(high, inverse, owner)
    return distinct, inverse, low < high


class _Part:
    """One part's documents with their anchors."""

    def __init__(self, table: pa.Table, length: int):
        self.ids = table["doc_id"].fill_null(np.iinfo(np.int64).max).to_numpy()
        self.table, self.length = table, length
        self.words = Words(*buffers(unsqueezed(table)["text"]), SPACE_SEPARATORS)
        self.hash = self.words.hashes()
        self.row = self.words.rows()
        self.anchor_width = length - PERIOD + 1
        left = self.words.left()
        whole = np.repeat(self.words.counts >= length, self.words.counts)
        self.anchor_at = np.flatnonzero(_in_cover(self.words) & whole & (left >= self.anchor_width))
        self.anchors, self.anchor_of, self.local = _groups_with_two(
            windows(self.hash, self.anchor_width)[self.anchor_at], self.ids[self.row[self.anchor_at]]
        )
        self.window_ok = left >= length

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """Windows that hold an anchor which another document holds too."""
        n = len(self.hash)
        hit = self.anchor_at[(shared | self.local)[self.anchor_of]]
        # An anchor at p lies in the windows that begin in [p - PERIOD + 1, p] of the same document.
        near = np.maximum(hit - PERIOD + 1, self.words.first[self.row[hit]]) if n else hit
        return np.flatnonzero(covered(near, hit - near + 1, n) & self.window_ok)


def _requests(part: int, keys: np.ndarray, shards: int) -> pa.Table:
    return blob_table([(s, part, keys[i:j].tobytes()) for s, i, j in pack_shards(keys, shards)])


def _answer(table: pa.Table, smaller: bool) -> pa.Table:
    """For each part its keys of this shard that a smaller (or else any other) part has too, as a bit each."""
    order = np.argsort(table["part"].to_numpy(), kind="stable")
    parts, blobs = table["part"].to_numpy()[order], [table["blob"][int(i)].as_py() for i in order]
    sizes = np.array([len(b) // 8 for b in blobs])
    keys, owner = np.frombuffer(b"".join(blobs), np.uint64), np.repeat(parts, sizes)
    by = np.argsort(keys, kind="stable")  # parts stay in order within a key
    head = np.diff(keys[by], prepend=~keys[by[:1]]) != 0
    group = np.cumsum(head) - 1
    size = np.bincount(group)
    told = np.empty(len(keys), bool)
    told[by] = ~head if smaller else (size > 1)[group]
    ends = np.cumsum(sizes)
    return blob_table([(int(p), int(table["shard"][0].as_py()), np.packbits(told[e - n : e]).tobytes()) for p, n, e in zip(parts, sizes, ends, strict=True)], ("part", "shard"))


def _bits(table: pa.Table, keys: np.ndarray, shards: int) -> np.ndarray:
    told = np.zeros(len(keys), bool)
    by_shard = dict(zip(table["shard"].to_pylist(), table["blob"].to_pylist(), strict=True))
    for s, i, j in pack_shards(keys, shards):
        told[i:j] = np.unpackbits(np.frombuffer(by_shard[s], np.uint8), count=j - i).astype(bool)
    return told


def _kept(part: _Part, removed: np.ndarray, texts: bool) -> tuple[list[str], list[str]]:
    """Kept words joined by one space, if ``texts`` are asked for, and their SHA-256, for each document; what has a number for each byte is made for few rows at a time."""
    words, whole, digests = part.words, [], []
    for first, last in chunks(words.offsets):
        base, stay = words.offsets[first], words.first[first] + np.flatnonzero(~removed[words.first[first] : words.first[last]])
        data = words.data[base : words.offsets[last]].copy()
        start, end, row = words.start[stay] - base, words.end[stay] - base, part.row[stay]
        keep = covered(start, end - start, len(data))
        joint = end[:-1][row[1:] == row[:-1]]
        data[joint] = 0x20
        keep[joint] = True
        at = np.concatenate([[0], np.cumsum(keep)])[words.offsets[first : last + 1] - base]
        out = data[keep].tobytes()
        pieces = [out[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
        digests += [hashlib.sha256(t).hexdigest() for t in pieces]
        whole += [t.decode("utf-8", "replace") for t in pieces] if texts else []
    return whole, digests


def substring_dedup(docs: DataFrame, length: int = 13, texts: bool = True) -> DataFrame:
    """Remove each word that lies in a window of ``length`` words which a document with a smaller id holds too.

    Difference-cover anchors: only windows of ``length - 6`` words that begin at positions
    1, 2 and 4 modulo 7 of a document are hashed and compared; any two equal windows of
    ``length`` words, wherever they begin, hold an anchor at the same offset. Shared anchors
    are then extended: the full windows around them are hashed and compared in turn.

    ``docs(doc_id, text)``; other columns are ignored. Returns (doc_id, n_words, n_removed,
    kept_sha256[, kept_text]), one row per input row. A null text has no words. Rows with equal
    ids don't remove each other's words; a null id counts as larger than all others. Windows
    are judged on the input, so a chain of copies all refer to the first. An empty table
    gives an empty table.
    """
    if length < PERIOD + 1:
        raise ValueError(f"length must be over {PERIOD}")
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    count = part_count(docs, text_bytes(docs))
    # Parts are ranges of ids: whatever a smaller part holds belongs to a smaller id.
    bounds = (docs.select(F.percentile_approx("doc_id", [k / count for k in range(1, count)], 100 * count)).first()[0] if count > 1 else None) or []
    bounds = np.unique(np.array(bounds, np.int64))

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        filled = ids.fillna(np.iinfo(np.int64).max).astype("int64") if ids.dtype != np.int64 else ids
        return pd.Series(np.searchsorted(bounds, filled.to_numpy(), "right").astype(np.int32))

    parts = squeezed(docs.select(part_of("doc_id").alias("part"), "doc_id", "text")).repartition(count, "part")

    def ask_anchors(table: pa.Table) -> pa.Table:
        part = _Part(table, length)
        return _requests(table["part"][0].as_py(), part.anchors, count)

    def ask_windows(docs_table: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs_table.num_rows:
            return blob_table([])
        part = _Part(docs_table, length)
        at = part.candidates(_bits(answers, part.anchors, count))
        return _requests(docs_table["part"][0].as_py(), np.unique(windows(part.hash, length)[at]), count)

    def remove(docs_table: pa.Table, answers: pa.Table) -> pa.Table:
        if docs_table.num_rows:
            part = _Part(docs_table, length)
            kind = answers["kind"].to_numpy()
            first, second = answers.filter(pa.array(kind == 1)), answers.filter(pa.array(kind == 2))
            at = part.candidates(_bits(first, part.anchors, count))
            keys, inverse = np.unique(windows(part.hash, length)[at], return_inverse=True)
            owner = part.ids[part.row[at]]
            low = np.full(len(keys), np.iinfo(np.int64).max)
            np.minimum.at(low, inverse, owner)
            hit = _bits(second, keys, count)[inverse] | (low[inverse] < owner)
            removed = covered(at[hit], length, len(part.hash))
            text, digest = _kept(part, removed, texts)
            counts, gone = part.words.counts, row_sums(removed.astype(np.int64), part.words.first)
            doc_id = docs_table["doc_id"]
        else:
            text, digest, counts, gone, doc_id = [], [], [], [], pa.array([], pa.int64())
        out = {"doc_id": doc_id, "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        return pa.table(out | ({"kept_text": pa.array(text, pa.string())} if texts else {}))

    answer_schema = "part int, shard int, blob binary"
    shared = (
        parts.groupBy("part").applyInArrow(ask_anchors, BLOB)
        .groupBy("shard").applyInArrow(lambda t: _answer(t, smaller=False), answer_schema)
    )
    earlier = (
        parts.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(ask_windows, BLOB)
        .groupBy("shard").applyInArrow(lambda t: _answer(t, smaller=True), answer_schema)
    )
    answers = shared.withColumn("kind", F.lit(1)).unionByName(earlier.withColumn("kind", F.lit(2)))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts
    return parts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(remove, schema)
