"""Operator 5: toxicity scores from boosted trees over dense features, calibrated."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import written
from .text import ALNUM_SEPARATORS, SPACE_SEPARATORS, Words, buffers, chunks, covered, row_sums

FOLDS = 4
SAMPLE_ROWS = 8_000  # labelled rows that the lexicon and the trees are fitted on, at most
LEXICON_UNITS = 256
LEAST_EVIDENCE = 30.0  # of a log-likelihood ratio
PREFIXES = (None, 5, 6, 7)  # a unit is a whole word or its first bytes
NEAR = 5
SECOND_PERSON = "you your yours yourself u ya tu toi te ton ta tes vous votre vos du dich dir dein deine ihr euch euer sie usted ustedes ti tú tus vosotros".split()


def _byte_sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return row_sums(mask.astype(np.int64), offsets)


def _units(words: Words) -> list[np.ndarray]:
    return [words.hashes(k) for k in PREFIXES]


def learn_lexicon(sample: DataFrame) -> dict[int, float]:
    """Log-odds of the words and word beginnings that tell the label best in ``sample(text, toxic)``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch["text"])
            toxic = batch["toxic"].to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in chunks(offsets):
                words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM_SEPARATORS, lower=True)
                row = words.rows()
                pair = np.unique(np.concatenate([np.stack([h, row.astype(np.uint64)], 1) for h in _units(words)]), axis=0)
                unit, inverse = np.unique(pair[:, 0], return_inverse=True)
                bad = np.bincount(inverse, toxic[i + pair[:, 1].astype(np.int64)], len(unit)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"unit": unit.view(np.int64), "bad": bad, "n": np.bincount(inverse, minlength=len(unit))})

    total = sample.agg(F.sum("toxic").cast("long"), F.count("*")).first()
    all_bad, rows = int(total[0] or 0), int(total[1])
    if not 0 < all_bad < rows:
        return {}
    found = (
        sample.select("text", "toxic").mapInArrow(count, "unit long, bad long, n long")
        .groupBy("unit").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).where("bad >= 4")
    )
    rate = all_bad / rows
    good = F.col("n") - F.col("bad")
    term = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / (F.col("n") * expected))).otherwise(0.0)
    scored = found.where(F.col("bad") > F.col("n") * rate).withColumn("evidence", 2 * (term(F.col("bad"), rate) + term(good, 1 - rate)))
    top = scored.where(F.col("evidence") >= LEAST_EVIDENCE).orderBy(F.desc("evidence"), "unit").limit(LEXICON_UNITS).collect()
    return {r.unit: float(np.log((r.bad + 0.5) / (all_bad + 1)) - np.log((r.n - r.bad + 0.5) / (rows - all_bad + 1))) for r in top}


FEATURES = (
    "log_words", "lexicon_density", "lexicon_hits", "lexicon_weight_density", "lexicon_most", "beginning_density", "beginning_hits",
    "near_second_person_density", "near_second_person_hits", "second_person_density", "capitals", "capital_words", "punctuation",
    "exclamations", "symbols", "digits", "obfuscated", "log_bytes",
)


def features(data: np.ndarray, offsets: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One row of dense features for each text; all 0 for an empty text. Only the text is used."""
    keys, weights = lexicon
    words = Words(data, offsets, ALNUM_SEPARATORS, lower=True)
    n, first = len(words.start), words.first
    count = np.maximum(words.counts, 1).astype(float)
    weight, whole, begun = np.zeros(n), np.zeros(n, bool), np.zeros(n, bool)
    second = np.isin(words.hashes(), _hash_words(SECOND_PERSON))
    if len(keys):
        for k, h in zip(PREFIXES, _units(words), strict=True):
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            (whole if k is None else begun)[hit] = True
            weight[hit] = np.maximum(weight[hit], weights[at[hit]])
    row = words.rows()
    spot = np.flatnonzero(second)
    low, high = np.maximum(spot - NEAR, first[row[spot]]), np.minimum(spot + NEAR + 1, first[row[spot] + 1])
    hit = whole | begun
    near = hit & covered(low, high - low, n)
    most = np.zeros(len(count))
    np.maximum.at(most, row, weight)
    raw = Words(data, offsets, SPACE_SEPARATORS)
    size = np.maximum(np.diff(offsets), 1).astype(float)
    upper = (data >= 0x41) & (data <= 0x5A)
    digit = (data >= 0x30) & (data <= 0x39)
    letter = upper | ((data >= 0x61) & (data <= 0x7A)) | (data >= 0x80)
    space = SPACE_SEPARATORS[data]
    mark = ~(letter | digit | space)
    symbol = mark & ~np.isin(data, np.frombuffer(b".,;:!?'\"()-", np.uint8))
    tokens = np.maximum(raw.counts, 1).astype(float)
    in_word = lambda m: np.concatenate([[0], np.cumsum(m)])[raw.end] - np.concatenate([[0], np.cumsum(m)])[raw.start]
    letters, inner = in_word(letter), in_word(digit | symbol)
    capital_word = (in_word(upper) >= 2) & (in_word(upper) == letters)
    sums = lambda x: row_sums(x.astype(float), first)
    token_sums = lambda x: row_sums(x.astype(float), raw.first)
    byte_sums = lambda m: _byte_sums(m, offsets) / size
    return np.stack([
        np.log1p(words.counts), sums(whole) / count, np.log1p(sums(whole)), sums(weight) / count, most, sums(begun) / count, np.log1p(sums(begun)),
        sums(near) / count, np.log1p(sums(near)), sums(second) / count, byte_sums(upper), token_sums(capital_word) / tokens, byte_sums(mark),
        byte_sums(data == 0x21), byte_sums(symbol), byte_sums(digit), token_sums((letters > 0) & (inner > 0)) / tokens, np.log1p(np.diff(offsets)),
    ], 1)


def _hash_words(words: list[str]) -> np.ndarray:
    data, offsets = buffers(pa.array(words))
    return Words(data, offsets, np.zeros(256, bool), lower=True).hashes()


@dataclass
class BoostedTrees:
    """Gradient-boosted regression trees on histograms of the features, for the log-loss."""

    trees: int = 60
    depth: int = 3
    rate: float = 0.15
    bins: int = 64
    least: int = 5
    ridge: float = 1.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        base = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(base / (1 - base)))
        margin = np.full(len(y), self.base)
        self.nodes = []  # of each tree: feature (-1: leaf), cut, value; children of i are 2i+1 and 2i+2
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            size = 2 ** (self.depth + 1) - 1
            feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
            at = np.zeros(len(y), np.int64)
            for node in range(size):
                own = np.flatnonzero(at == node)
                if not len(own):
                    continue
                sum_g, sum_h = g[own].sum(), h[own].sum()
                value[node] = -self.rate * sum_g / (sum_h + self.ridge)
                if node >= 2**self.depth - 1 or len(own) < 2 * self.least:
                    continue
                best = (1e-6, -1, 0)
                for f in range(x.shape[1]):
                    k = len(self.cuts[f]) + 1
                    gs, hs, ns = (np.cumsum(np.bincount(binned[own, f], w, k))[:-1] for w in (g[own], h[own], np.ones(len(own))))
                    gain = gs**2 / (hs + self.ridge) + (sum_g - gs) ** 2 / (sum_h - hs + self.ridge) - sum_g**2 / (sum_h + self.ridge)
                    gain[(ns < self.least) | (len(own) - ns < self.least)] = -1
                    if len(gain) and gain.max() > best[0]:
                        best = (gain.max(), f, int(gain.argmax()))
                if best[1] >= 0:
                    feature[node], cut[node] = best[1], self.cuts[best[1]][best[2]]
                    at[own] = np.where(binned[own, best[1]] <= best[2], 2 * node + 1, 2 * node + 2)
            margin += value[at]
            self.nodes.append((feature, cut, value))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, cut, value in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                inner = f >= 0
                go = x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at]
                at = np.where(inner, np.where(go, 2 * at + 1, 2 * at + 2), at)
            out += value[at]
        return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of a rising map from margin to probability, read by interpolation."""
    at, inverse = np.unique(margin, return_inverse=True)
    weight, value = np.bincount(inverse).astype(float), np.bincount(inverse, y) / np.bincount(inverse)
    blocks: list[list[float]] = []  # mean, weight, first, last
    for m, v, w in zip(at, value, weight, strict=True):
        blocks.append([v, w, m, m])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]])
    x = np.array([v for b in blocks for v in (b[2], b[3])])
    p = np.array([(b[0] * b[1] + 0.5) / (b[1] + 1) if len(blocks) < 2 else b[0] for b in blocks for _ in range(2)])
    return x, np.maximum.accumulate(p)


@dataclass
class ToxicityModel:
    lexicon: tuple[np.ndarray, np.ndarray]
    trees: BoostedTrees | None
    knots: tuple[np.ndarray, np.ndarray]
    base: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(offsets) - 1, self.base)
        margin = self.trees.margin(features(data, offsets, self.lexicon))
        # A slight share of the uncalibrated probability keeps the order inside a calibrated step.
        return np.clip(0.98 * np.interp(margin, *self.knots) + 0.02 / (1 + np.exp(-margin)), 0, 1)


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fit on at most ``sample_rows`` labelled rows, those with the smallest hashes of doc_id.

    The bound makes lexicon, trees and calibration a fixed amount of work on the driver; scoring
    covers every row. Rows of ``labels(doc_id, toxic)`` with null are ignored, of several for an
    id the largest counts, and of several texts of an id the smallest: no id counts twice, so the
    bound holds whatever repeats. Calibration uses scores of lexicons and trees that did not see the row.
    """
    rows = labels.where("doc_id is not null and toxic is not null")
    rows = (rows.where(usable) if usable is not None else rows).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    once = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    sample = written(once.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int")))
    lexicon = _lexicon(sample)
    x, y, fold = _described(sample, lexicon)
    base = float((y.sum() + 0.5) / (len(y) + 1))
    if len(y) < 20 or not 0 < y.sum() < len(y):
        return ToxicityModel(lexicon, None, (np.zeros(1), np.zeros(1)), min(base, 1.0))
    out = np.zeros(len(y))
    for k in range(FOLDS):
        own = fold == k
        if own.any() and y[~own].sum():
            seen, _, _ = _described(sample, _lexicon(sample.where(F.col("fold") != k)))
            out[own] = BoostedTrees().fit(seen[~own], y[~own]).margin(seen[own])
    return ToxicityModel(lexicon, BoostedTrees().fit(x, y), isotonic(out, y), base)


def _lexicon(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    learned = learn_lexicon(sample)
    keys = np.array(list(learned), np.int64).view(np.uint64)
    by = np.argsort(keys)
    return keys[by], np.array(list(learned.values()))[by].astype(float)


def _described(sample: DataFrame, lexicon: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and folds of the sample's rows in order of doc_id."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch["text"])
            for i, j in chunks(offsets):
                x = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lexicon)
                yield pa.RecordBatch.from_pydict({c: batch[c][i:j] for c in ("doc_id", "toxic", "fold")} | {"x": pa.array(list(x), pa.list_(pa.float64()))})

    table = sample.mapInArrow(describe, "doc_id long, toxic int, fold int, x array<double>").toArrow()
    order = np.argsort(table["doc_id"].to_numpy(), kind="stable")
    x = np.array(table["x"].to_pylist())[order] if len(order) else np.zeros((0, 1))
    return x, table["toxic"].to_numpy()[order].astype(float), table["fold"].to_numpy()[order]


def toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs(doc_id, text)``, from its whole text alone.

    A null text scores as an empty one; equal texts score equally, so repeated rows and ties do; a long text is read whole; an empty
    table gives an empty one. Other columns are ignored, whatever their names; a null doc_id stays null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch["text"])
            parts = [shared.value.scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in chunks(offsets, 1 << 20)]
            s = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "score": pa.array(s), "predicted": pa.array((s >= 0.5).astype(np.int32))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, score double, predicted int")


def held_out(doc_id: Column) -> Column:
    """Whether the label must not be learned; a null id is not held out, and has no label."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
