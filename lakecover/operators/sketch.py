"""Sketching payloads, and what can be said from sketches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from .similarity import block_pairs, two_blocks

SKETCH = "signature binary, real binary, genome_length long, n_real_bins int, n_contigs int, error string"


def words_of(payload: bytes, k: int, syncmer: int, kind: str) -> tuple[np.ndarray, int, int]:
    """Words of a payload, its length and its headers; kind is "sequence", "text" (as bases) or "shingle"."""
    if kind == "shingle":
        text = payload.decode("utf-8", "replace")
        return K.shingle_words(text, min(k, 8)), len(text), 0
    codes, bases, contigs = K.base_codes(K.text_as_bases(payload.decode("utf-8", "replace")) if kind == "text" else payload)
    return (K.syncmers(codes, k, syncmer) if syncmer else K.canonical_kmers(codes, k)), bases, contigs


def sketch_payloads(items: DataFrame, id: str, payload: str, *, k: int = 21, bins: int = 10_000, syncmer: int = 0, kind: str = "sequence", second: bool = False, densify: bool = True) -> DataFrame:
    """(id, signature, real, genome_length, n_real_bins, n_contigs, error[, second]) for each item.

    ``signature`` holds the low 16 bits of each bin's smallest upper hash half, little-endian, with empty bins filled from
    neighbours; ``real`` the bits of bins that hold a hash. An item that can't be sketched is an error row.
    """
    kinds = dict(items.dtypes)
    text = kinds[payload] == "string"

    def one(content: bytes) -> tuple:
        words, bases, contigs = words_of(content, k, syncmer, kind)
        signature, real = K.one_permutation(words, bins)
        minima = [signature, K.one_permutation(words, bins, K.SEED_2)[0]] if second else [signature]
        return minima, np.packbits(real, bitorder="little").tobytes(), bases, int(real.sum()), contigs

    def packed(minima: list[np.ndarray]) -> list[bytes | None]:
        """The 16-bit signatures of a slice, filled all at once."""
        known = [m for m in minima if m is not None]
        whole = iter((K.densify(np.stack(known)) if densify else np.stack(known)).astype("<u2")) if known else iter(())
        return [None if m is None else next(whole).tobytes() for m in minima]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, payload):
            out: list[tuple] = []
            for content in batch[payload].to_pylist():
                try:
                    if content is None:
                        raise ValueError("no payload")
                    out.append((*one(content.encode() if text else content), None))
                except Exception as e:  # one item's fault is its own
                    out.append(([None] * (1 + second), None, None, None, None, str(e) or type(e).__name__))
            minima, real, bases, n_real, contigs, error = zip(*out, strict=True) if out else ((),) * 6
            yield pa.RecordBatch.from_pydict({
                id: batch[id], "signature": pa.array(packed([m[0] for m in minima]), pa.binary()), "real": pa.array(real, pa.binary()), "genome_length": pa.array(bases, pa.int64()),
                "n_real_bins": pa.array(n_real, pa.int32()), "n_contigs": pa.array(contigs, pa.int32()), "error": pa.array(error, pa.string()),
            } | ({"second": pa.array(packed([m[1] for m in minima]), pa.binary())} if second else {}))

    return items.select(id, payload).mapInArrow(run, f"{id} {kinds[id]}, {SKETCH}" + ", second binary" * second)


SLICE_ROWS, SLICE_BYTES = 256, 4 << 20  # Rows and bytes of texts that are unpacked and sketched before their rows go on.


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Batches cut to so few rows and bytes that what is made of them stays small, however large batches come; a longer text is alone."""
    for batch in batches:
        size = np.cumsum([n or 0 for n in pc.binary_length(batch[text]).to_pylist()])
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            end = min(at + SLICE_ROWS, max(at + 1, int(np.searchsorted(size, before + SLICE_BYTES, "right"))))
            yield batch.slice(at, end - at)
            at = end


class PartialSketch:
    """The sketch of a FASTA file from pieces of it: words across pieces are carried over, minima by bin are merged.

    Memory is one piece and the bins, whatever the file's size; the result is that of ``sketch_payloads`` over the whole.
    """

    def __init__(self, k: int, bins: int, syncmer: int = 0, second: bool = False):
        self.k, self.syncmer, self.seeds = k, syncmer, (K.SEED_1, K.SEED_2) if second else (K.SEED_1,)
        self.minima = [np.full(bins, K.EMPTY, np.uint32) for _ in self.seeds]
        self.carried = np.zeros(0, np.uint8)
        self.bases = self.contigs = 0
        self.at_line_start, self.in_header = True, False

    def add(self, piece: bytes) -> None:
        if self.in_header:
            end = piece.find(b"\n")
            if end < 0:
                return
            piece, self.in_header, self.at_line_start = piece[end + 1 :], False, True
        if not piece:
            return
        codes, bases, contigs = K.base_codes(piece if self.at_line_start else b"\r" + piece)
        self.bases, self.contigs = self.bases + bases, self.contigs + contigs
        line = piece.rfind(b"\n") + 1
        self.in_header = piece[line : line + 1] == b">" and (line > 0 or self.at_line_start)
        self.at_line_start = line == len(piece)
        codes = np.concatenate([self.carried, codes])
        self.carried = codes[max(0, len(codes) - self.k + 1) :]
        words = K.syncmers(codes, self.k, self.syncmer) if self.syncmer else K.canonical_kmers(codes, self.k)
        for seed, low in zip(self.seeds, self.minima, strict=True):
            np.minimum(low, K.one_permutation(words, len(low), seed)[0], out=low)

    def merge(self, other: PartialSketch) -> None:
        """Takes in the sketch of other sequences, such as those of another file of the item."""
        for low, more in zip(self.minima, other.minima, strict=True):
            np.minimum(low, more, out=low)
        self.bases, self.contigs = self.bases + other.bases, self.contigs + other.contigs

    def result(self, densify: bool = True) -> dict[str, object]:
        packed = [(K.densify(m) if densify else m).astype(np.uint16).astype("<u2").tobytes() for m in self.minima]
        real = self.minima[0] != K.EMPTY
        made = {"signature": packed[0], "real": np.packbits(real, bitorder="little").tobytes(), "genome_length": self.bases, "n_real_bins": int(real.sum()), "n_contigs": self.contigs, "error": None}
        return made | ({"second": packed[1]} if len(packed) > 1 else {})


def sketch_files(items: DataFrame, id: str, file: str, *, k: int = 21, bins: int = 10_000, syncmer: int = 0, second: bool = False, piece: int | None = None) -> DataFrame:
    """``sketch_payloads`` for files that tasks read themselves, piece by piece: no file is held whole, nor sent between processes.

    A read that fails is tried again from the start of its file; an item that can't be read is an error row.
    """
    from ..sources.streams import CHUNK, chunks, opened

    kinds, names = dict(items.dtypes), [c.split()[0] for c in SKETCH.split(", ")] + ["second"] * second
    types = {"signature": pa.binary(), "real": pa.binary(), "genome_length": pa.int64(), "n_real_bins": pa.int32(), "n_contigs": pa.int32(), "error": pa.string(), "second": pa.binary()}

    def one(path: str) -> dict[str, object]:
        made = PartialSketch(k, bins, syncmer, second)
        with opened(path) as stream:
            for content in chunks(stream, piece or CHUNK):
                made.add(content)
        return made.result()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict[str, object]] = []
            for path in batch[file].to_pylist():
                try:
                    if path is None:
                        raise ValueError("no file")
                    out.append(retrying(lambda path=path: one(path)))
                except Exception as e:
                    out.append({"error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pydict({id: batch[id]} | {c: pa.array([r.get(c) for r in out], types[c]) for c in names})

    return items.select(id, file).mapInArrow(run, f"{id} {kinds[id]}, {SKETCH}" + ", second binary" * second)


def retrying[R](read: Callable[[], R], tries: int = 3, waits: tuple[float, ...] = (0.5, 1.0)) -> R:
    """A read that is tried again after growing waits."""
    for n in range(tries):
        try:
            return read()
        except OSError:
            if n == tries - 1:
                raise
            time.sleep(waits[min(n, len(waits) - 1)])
    raise AssertionError


def words_relational(items: DataFrame, id: str, text: str, k: int) -> DataFrame:
    """(id, word) of ordinary text as base words in SQL terms alone: one row per position, canonical codes of k <= 21 bases.

    For checks and small inputs; ``sketch_payloads`` is the fast way.
    """
    chars = F.filter(F.transform(F.split(text, ""), lambda c: F.ascii(c)), lambda c: (c != 10) & (c > 0))
    each = items.select(id, chars.alias("_c")).select(id, F.explode(F.sequence(F.lit(1), F.greatest(F.size("_c") - k + 1, F.lit(0)))).alias("_p"), "_c").where("_p > 0")
    window = F.slice("_c", F.col("_p"), k)
    whole = each.select(id, window.alias("_w")).where(~F.exists("_w", lambda c: (c >= 48) & (c <= 57)))
    forward = F.aggregate("_w", F.lit(0).cast("long"), lambda s, c: F.shiftleft(s, 2).bitwiseOR(F.pmod(c, F.lit(4)).cast("long")))
    backward = F.aggregate(F.reverse("_w"), F.lit(0).cast("long"), lambda s, c: F.shiftleft(s, 2).bitwiseOR((3 - F.pmod(c, F.lit(4))).cast("long")))
    return whole.select(id, F.least(forward, backward).alias("word"))


def bin_minima(items: DataFrame, id: str, text: str, k: int, bins: int) -> DataFrame:
    """(id, bin, low): smallest upper hash half of each bin that holds a hash; hashes in numpy, minima by a combining aggregation."""
    kinds = dict(items.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = [K.one_permutation(words_of((content or "").encode(), k, 0, "text")[0], bins) for content in batch[text].to_pylist()]
            at = [np.flatnonzero(real) for _, real in found]
            rows = np.repeat(np.arange(len(at)), [len(a) for a in at])
            low = np.concatenate([signature[a] for (signature, _), a in zip(found, at, strict=True)]) if at else np.zeros(0)
            yield pa.RecordBatch.from_pydict({id: batch[id].take(pa.array(rows)), "bin": pa.array(np.concatenate(at) if at else np.zeros(0), pa.int64()), "low": pa.array(low.astype(np.int64))})

    return items.select(id, text).mapInArrow(run, f"{id} {kinds[id]}, bin long, low long").groupBy(id, "bin").agg(F.min("low").alias("low"))


def shingle_rows(items: DataFrame, id: str, text: str, n: int = 3) -> DataFrame:
    """(id, shingle): distinct word n-grams of each text, in SQL terms."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)
    grams = F.transform(F.sequence(F.lit(1), F.size("_w") - (n - 1)), lambda p: F.array_join(F.slice("_w", p, n), " "))
    return items.select(id, words.alias("_w")).where(F.size("_w") >= n).select(id, F.explode(F.array_distinct(grams)).alias("shingle"))


def set_jaccard(rows: DataFrame, id: str, item: str, pairs: DataFrame | None = None) -> DataFrame:
    """(a, b, common, jaccard) of the sets in ``rows(id, item)`` that share an item, from an equi-join; only ``pairs(a, b)`` if given."""
    size = rows.groupBy(id).agg(F.count("*").alias("n"))
    common = rows.select(F.col(id).alias("a"), item).join(rows.select(F.col(id).alias("b"), item), item).where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    common = common.join(pairs, ["a", "b"], "left_semi") if pairs is not None else common
    na, nb = size.withColumnsRenamed({id: "a", "n": "na"}), size.withColumnsRenamed({id: "b", "n": "nb"})
    return common.join(na, "a").join(nb, "b").select("a", "b", "common", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("jaccard"))


def set_containment(queries: DataFrame, targets: DataFrame, qid: str, tid: str, item: str) -> DataFrame:
    """(query, target, common, containment): share of the query's items that the target holds."""
    size = queries.groupBy(qid).agg(F.count("*").alias("n"))
    common = queries.join(targets, item).groupBy(qid, tid).agg(F.count("*").alias("common"))
    return common.join(size, qid).select(qid, tid, "common", (F.col("common") / F.col("n")).alias("containment"))


def bottom_sketches(items: DataFrame, id: str, text: str, k: int = 8, size: int = 100) -> DataFrame:
    """(id, rank, hash): bottom sketches of byte shingles; hashes as longs whose bit patterns sort unsigned by rank."""
    kinds = dict(items.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = [K.bottom_sketch(K.shingle_words(content or "", k), size) for content in batch[text].to_pylist()]
            rows = np.repeat(np.arange(len(found)), [len(h) for h in found])
            ranks = np.concatenate([np.arange(len(h)) for h in found]) if found else np.zeros(0)
            hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_pydict({id: batch[id].take(pa.array(rows)), "rank": pa.array(ranks, pa.int32()), "hash": pa.array(hashes.astype(np.uint64).view(np.int64))})

    return items.select(id, text).mapInArrow(run, f"{id} {kinds[id]}, rank int, hash long")


def sketch_distances(pairs: DataFrame, group: str) -> DataFrame:
    """(group, a, b, dist): angular distances of ``pairs(group, a, b, pa, pb)`` of signatures."""
    kinds = dict(pairs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            j = [K.jaccard_16(np.frombuffer(x, "<u2"), np.frombuffer(y, "<u2")) for x, y in zip(batch["pa"].to_pylist(), batch["pb"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({c: batch[c] for c in (group, "a", "b")} | {"dist": pa.array(np.arccos(np.clip(j, -1, 1)) / np.pi, pa.float64())})

    return pairs.select(group, "a", "b", "pa", "pb").mapInArrow(run, f"{group} {kinds[group]}, a {kinds['a']}, b {kinds['b']}, dist double")


PAIR_ROWS, PAIRS = 8192, 1 << 18  # Signatures of a block, and pairs that a task compares at a time.


def equal_bins(left: np.ndarray, right: np.ndarray, order: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    """How many bins of each two rows are equal, by looking up the left rows' tokens among the right rows' (``sorted_`` by ``order``, flat).

    Where matches outnumber what a comparison of all bins takes, such as among copies, it is that comparison.
    """
    bins = left.shape[1]
    low, high = np.searchsorted(sorted_, left.ravel(), "left"), np.searchsorted(sorted_, left.ravel(), "right")
    n = high - low
    if int(n.sum()) > len(left) * len(right) * 8:
        return np.stack([(row == right).sum(axis=1) for row in left])
    at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
    rows = np.repeat(np.repeat(np.arange(len(left)), bins), n)
    return np.bincount(rows * len(right) + order[at] // bins, minlength=len(left) * len(right)).reshape(len(left), len(right))


def sketch_pairs(sketches: DataFrame, id: str, group: str, over: float | None = None, block: int | None = None) -> DataFrame:
    """(group, a, b, jaccard) of the pairs a < b of a group's 16-bit signatures, all or those whose similarity is greater than ``over``.

    By blocks: a task holds two of them and hands on its pairs in batches.
    """
    kinds = dict(sketches.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, left, right, one = two_blocks(batches)
        ids, kind, grp, chance = table["_id"].to_numpy(), table["_id"].type, table["_group"].combine_chunks(), 2.0**-16
        values = np.stack([np.frombuffer(s, "<u2") for s in table["signature"].to_pylist()])
        bins = values.shape[1]
        tokens = values.astype(np.uint32) | (np.arange(bins, dtype=np.uint32) << 16)
        far, far_ids = tokens[right], ids[right]
        order = np.argsort(far.ravel(), kind="stable")
        sorted_, step = far.ravel()[order], max(1, PAIRS // max(1, len(right)))
        for i in range(0, len(left) if len(right) else 0, step):
            at = left[i : i + step]
            j = np.maximum(0.0, (equal_bins(tokens[at], far, order, sorted_) / bins - chance) / (1 - chance))
            own = ids[at]
            near = own[:, None] < far_ids[None, :] if one else own[:, None] != far_ids[None, :]
            rows, cols = np.nonzero(near if over is None else near & (j > over))
            if len(rows):
                a, b = own[rows], far_ids[cols]
                swap = a > b
                a, b = np.where(swap, b, a), np.where(swap, a, b)
                yield pa.RecordBatch.from_arrays([grp.take(pa.array(np.zeros(len(a), np.int64))), pa.array(a, kind), pa.array(b, kind), pa.array(j[rows, cols])], [group, "a", "b", "jaccard"])

    rows = sketches.where("signature is not null").select(F.col(group).alias("_group"), F.col(id).alias("_id"), "signature")
    return block_pairs(rows, block or PAIR_ROWS).groupBy("_group", "_x", "_y").applyInArrow(run, f"{group} {kinds[group]}, a {kinds[id]}, b {kinds[id]}, jaccard double")
