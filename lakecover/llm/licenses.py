"""Operator 7: license notices in documents, by winnowed fingerprints and banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .exchange import private
from .text import ALNUM_SEPARATORS, Words, buffers, chunks, windows

GRAM, WINDOW = 3, 2  # any GRAM + WINDOW - 1 equal words share a fingerprint
LEAST_COVERAGE = 0.8
BLOCK_BYTES = 32 << 20
NOTICE_WORDS = 60  # in a template of no more words, names and versions must agree
QUALIFIERS = {b"nc", b"nd", b"sa", b"lesser", b"library", b"affero"}  # words by which one license's name differs from another's

# Usual notices by the licenses' common identifiers.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "all-rights-reserved": "All rights reserved.",
}


def notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NOTICES.items()), "template_id string, text string")


def winnowed(h: np.ndarray, first: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions that hold the least hash (of equal ones the last) of some ``window`` consecutive ones of their row; a shorter row has one."""
    keep = np.zeros(len(h), bool)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n = len(h) - window + 1
    if n > 0:
        view = np.lib.stride_tricks.sliding_window_view(h, window)
        whole = row[:n] == row[window - 1 :]
        at = np.arange(n) + window - 1 - view[:, ::-1].argmin(axis=1)
        keep[at[whole]] = True
    for r in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < window)):
        keep[first[r] + int(h[first[r] : first[r + 1]].argmin())] = True
    return np.flatnonzero(keep)


def banded_alignment(template: np.ndarray, words: np.ndarray, offset: int, band: int) -> list[int]:
    """Positions of the words on the longest common subsequence whose places differ from ``offset`` by no more than the band.

    Word j may meet template word i if ``|j - i - offset| <= band``. Ties take the earliest words.
    """
    width = 2 * band + 1
    best = [[0] * (width + 1) for _ in range(len(template) + 1)]  # best[i][d]: from template word i on, at word i + offset - band + d
    for i in range(len(template) - 1, -1, -1):
        below, own = best[i + 1], best[i]
        for d in range(width - 1, -1, -1):
            j = i + offset - band + d
            score = max(own[d + 1], below[d - 1] if d else 0)
            if 0 <= j < len(words) and words[j] == template[i]:
                score = max(score, below[d] + 1)
            own[d] = score
    i, d, path = 0, 0, []
    while i < len(template) and d < width:
        j = i + offset - band + d
        if 0 <= j < len(words) and words[j] == template[i] and best[i][d] == best[i + 1][d] + 1:
            path.append(j)
            i += 1
        elif best[i][d] == best[i][d + 1]:
            d += 1
        else:
            i, d = i + 1, d - 1
    return path


def _tightened(path: list[int], words: np.ndarray) -> list[int]:
    """The same words as ``path`` with the same last one, each as late as may be."""
    out, j = [], path[-1]
    for k in reversed(path):
        while words[j] != words[k]:
            j -= 1
        out.append(j)
        j -= 1
    return out[::-1]


def _telling(words: Words, k: int, numbers: bool) -> bool:
    """Whether word ``k`` tells licenses apart: a qualifier or, if ``numbers``, a word with a digit."""
    word = words.data[words.start[k] : words.end[k]].tobytes()
    return word in QUALIFIERS or (numbers and any(0x30 <= c < 0x3A for c in word))


class TemplateIndex:
    """Inverted index from fingerprints to (template, place), for a bounded block of templates."""

    def __init__(self, ids: list[str], texts: pa.Array, gram: int = GRAM):
        words = Words(*buffers(texts), ALNUM_SEPARATORS, lower=True)
        self.gram, self.ids = gram, ids
        hashes = words.hashes()
        self.words = [hashes[a:b] for a, b in zip(words.first, words.first[1:], strict=False)]
        self.numbers, self.telling = [], []
        for a, b in zip(words.first, words.first[1:], strict=False):
            self.numbers.append(any(_telling(words, k, True) and not _telling(words, k, False) for k in range(a, min(b, a + NOTICE_WORDS))))
            self.telling.append(sum(_telling(words, k, self.numbers[-1]) for k in range(a, b)) if b - a <= NOTICE_WORDS else None)
        keys, places = [], []
        for t, own in enumerate(self.words):
            for width in {min(gram, len(own))} - {0}:
                h = windows(own, width)
                for at in winnowed(h, np.array([0, len(h)])):
                    keys.append(h[at])
                    places.append((t, at))
        by = np.argsort(np.array(keys, np.uint64), kind="stable")
        self.keys, self.places = np.array(keys, np.uint64)[by], np.array(places, np.int64).reshape(-1, 2)[by]
        self.coarse = np.zeros(1 << 16, bool)
        self.coarse[self.keys >> np.uint64(48)] = True
        self.widths = sorted({min(gram, len(w)) for w in self.words if len(w)})

    def matches(self, words: Words, least: float) -> list[tuple[int, int, int, int, float, int, int]]:
        """(row, template, first word, word after the last, coverage, matched words, unmatched ones of both sides) of all matches; of overlapping ones of a template the best."""
        hashes, candidates = words.hashes(), set()
        for width in self.widths:
            h = windows(hashes, width)
            left = words.left()[: len(h)]
            at = np.flatnonzero((left >= width) & self.coarse[h >> np.uint64(48)])
            low, high = np.searchsorted(self.keys, h[at]), np.searchsorted(self.keys, h[at], "right")
            hit = np.flatnonzero(high > low)
            rows = np.searchsorted(words.first, at[hit], "right") - 1
            for k, row in zip(hit, rows, strict=True):
                for t, place in self.places[low[k] : high[k]]:
                    band = self._band(int(t))
                    # Hits whose offsets differ by less than the band are one candidate.
                    candidates.add((int(row), int(t), int(at[k] - words.first[row] - place) // max(1, band)))
        found: dict[tuple[int, int], list] = {}
        for row, t, step in sorted(candidates):
            template, band = self.words[t], self._band(t)
            own = hashes[words.first[row] : words.first[row + 1]]
            path = banded_alignment(template, own, step * max(1, band) + band // 2, 2 * band)
            if not path:
                continue
            path = _tightened(path, own)
            length = path[-1] + 1 - path[0]
            coverage = len(path) / (len(template) + length - len(path))
            if coverage >= least and self._agrees(t, words, words.first[row], path):
                found.setdefault((row, t), []).append((-coverage, path[0], path[-1] + 1, len(path), len(template) + length - 2 * len(path)))
        out = []
        for (row, t), spans in found.items():
            taken: list[tuple[int, int]] = []
            for minus, a, b, matched, unmatched in sorted(spans):
                if all(b <= x or a >= y for x, y in taken):
                    taken.append((a, b))
                    out.append((row, t, a, b, -minus, matched, unmatched))
        return sorted(out)

    def _agrees(self, t: int, words: Words, base: int, path: list[int]) -> bool:
        """Whether a short template's telling words are all matched and the span has no others."""
        if self.telling[t] is None:
            return True
        matched = sum(_telling(words, base + k, self.numbers[t]) for k in path)
        return matched == self.telling[t] == sum(_telling(words, base + k, self.numbers[t]) for k in range(path[0], path[-1] + 1))

    def _band(self, t: int) -> int:
        return max(1, len(self.words[t]) // 5)


def _chosen(found: list[dict]) -> list[dict]:
    """Of overlapping matches that with the most matched, then the fewest unmatched words, then the smaller id; by place."""
    kept: list[dict] = []
    for m in sorted(found, key=lambda m: (-m["matched"], m["unmatched"], m["id"], m["first"])):
        if all(m["last"] <= k["first"] or m["first"] >= k["last"] for k in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: (m["first"], m["last"], m["id"]))


def license_scan(docs: DataFrame, templates: DataFrame, least: float = LEAST_COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Notices of ``templates(template_id, text)`` in each of ``docs(doc_id, text)``.

    Words are compared in lower case without punctuation. Templates are winnowed: of each two neighbouring 3-word
    hashes the smaller stands in an inverted index, in which every 3-word hash of a document is looked up; so any
    four words of a template in a row are met, and templates too short to winnow by their one hash. Each candidate offset is aligned in a band of a fifth of the template's length to either side; a match covers
    ``least`` of the template's words and of those that the span has besides. In templates of up to 60 words, qualifiers
    (NC, SA, Lesser, ...) and, if the template has any, numbers must be the same on both sides, since licenses differ by
    them; a notice that differs there is reported under no id. Of overlapping matches of different templates that with the
    most matched words stays, then that with the fewest unmatched ones of both sides, then the smaller id. A template of fewer than three words must be met by all its words.

    The index of a block of templates of at most ``block_bytes`` is broadcast; more templates make more blocks,
    scanned in turn in the same tasks without a shuffle. Returns the columns of ``docs`` but clashing ones, and
    n_words, n_matches, licenses (ids, sorted, comma-joined), best_coverage (0 without a match), spans (as
    id:from-to in words, sorted by place). A null text has no words; templates without words or id match
    nothing; repeated rows get equal results; a long text is scanned whole; an empty table of either kind is allowed.
    """
    made = ["n_words", "n_matches", "licenses", "best_coverage", "spans"]
    kept = docs.drop(*made)
    spark, names = docs.sparkSession, kept.columns
    (found,) = private([*names, *made], "found")
    usable = templates.select(F.col("template_id").cast("string").alias("template_id"), F.col("text").cast("string").alias("text")).where("template_id is not null and text is not null")
    size = usable.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    found_kind = "array<struct<id:string,first:int,last:int,coverage:double,matched:int,unmatched:int>>"
    scanned = kept.withColumn(found, F.array().cast(found_kind))
    kind = pa.list_(pa.struct([("id", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("coverage", pa.float64()), ("matched", pa.int32()), ("unmatched", pa.int32())]))
    for b in range(blocks):
        block = usable.where(F.pmod(F.xxhash64("template_id", "text"), F.lit(blocks)) == b) if blocks > 1 else usable
        rows = block.toArrow()
        index = spark.sparkContext.broadcast(TemplateIndex(rows["template_id"].to_pylist(), rows["text"]))

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = buffers(batch["text"])
                held = batch[found].to_pylist()
                for i, j in chunks(offsets):
                    words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM_SEPARATORS, lower=True)
                    for row, t, a, z, coverage, matched, unmatched in index.value.matches(words, least):
                        held[i + row] = [*held[i + row], {"id": index.value.ids[t], "first": a, "last": z, "coverage": coverage, "matched": matched, "unmatched": unmatched}]
                yield pa.RecordBatch.from_arrays([pa.array(held, kind) if c == found else batch[c] for c in batch.schema.names], batch.schema.names)

        scanned = scanned.mapInArrow(scan, scanned.schema)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch["text"])
            counts = [Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM_SEPARATORS, lower=True).counts for i, j in chunks(offsets)]
            held = [_chosen(x) for x in batch[found].to_pylist()]
            yield pa.RecordBatch.from_pydict({c: batch[c] for c in names} | {
                "n_words": pa.array(np.concatenate(counts) if counts else [], pa.int64()), "n_matches": pa.array([len(x) for x in held], pa.int64()),
                "licenses": pa.array([",".join(sorted({m["id"] for m in x})) for x in held], pa.string()), "best_coverage": pa.array([max((m["coverage"] for m in x), default=0.0) for x in held]),
                "spans": pa.array([",".join(f"{m['id']}:{m['first']}-{m['last']}" for m in x) for x in held], pa.string()),
            })

    ddl = "n_words long, n_matches long, licenses string, best_coverage double, spans string"
    return scanned.mapInArrow(finish, T.StructType([*kept.schema.fields, *spark.createDataFrame([], ddl).schema.fields]))
