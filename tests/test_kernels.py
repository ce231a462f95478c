"""Sketch kernels against plain versions in Python integers."""

import gzip

import numpy as np
import pytest

from lakecover.functions import kernels as K
from lakecover.operators import calibrate, cover, graph
from lakecover.operators.embedding import Nystrom, anchor_count, stratified_anchors
from lakecover.sources.sequences import decompress

MASK = (1 << 64) - 1
PAIR = {"A": "T", "C": "G", "G": "C", "T": "A"}
CODE = {b: i for i, b in enumerate("ACGT")}


def sequence(n, seed=1):
    out, x = [], seed
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) & MASK
        out.append("ACGT"[x >> 62])
    return "".join(out)


def plain_words(seq, k):
    number = lambda s: sum(CODE[b] << (2 * (k - 1 - i)) for i, b in enumerate(s))
    out = []
    for i in range(len(seq) - k + 1):
        w = seq[i : i + k]
        if set(w) <= set(CODE):
            out.append(min(number(w), number("".join(PAIR[b] for b in reversed(w)))))
    return out


def plain_sketch(words, bins, seed):
    sig = [0xFFFFFFFF] * bins
    for c in words:
        p = (c ^ ((seed + K.WY_0) & MASK)) * (c ^ K.WY_1)
        h = (p & MASK) ^ (p >> 64)
        sig[h * bins >> 64] = min(sig[h * bins >> 64], h >> 32)
    return sig


@pytest.mark.parametrize("k", [1, 8, 21, 32])
def test_canonical_words(k):
    seq = sequence(300) + "N" + sequence(100, 5)
    codes, bases, contigs = K.base_codes(f">x\n{seq[:150]}\r\n{seq[150:]}\n".encode())
    assert (bases, contigs) == (400, 1)
    assert K.canonical_kmers(codes, k).tolist() == plain_words(seq, k)
    assert not len(K.canonical_kmers(codes, 33))


def test_headers_break_words_and_line_ends_do_not():
    codes, bases, contigs = K.base_codes(b">a\nACG\nT\n>b ACGT\nacgt")
    assert (bases, contigs) == (8, 2)
    assert K.canonical_kmers(codes, 4).tolist() == plain_words("ACGT", 4) * 2


@pytest.mark.parametrize("bins", [7, 256])
def test_one_permutation_sketch(bins):
    words = K.canonical_kmers(K.base_codes(sequence(2000).encode())[0], 16)
    signature, real = K.one_permutation(words, bins)
    want = plain_sketch(words.tolist(), bins, 42)
    assert signature.tolist() == want and real.tolist() == [x != 0xFFFFFFFF for x in want]


@pytest.mark.parametrize("filled", [[], [0], [3], [9], [0, 4, 9], list(range(10))])
def test_densify(filled):
    sig = np.full(10, K.EMPTY)
    sig[filled] = np.arange(len(filled)) + 5
    want = [int(x) for x in sig]
    for order, step in ((range(1, 10), 1), (range(8, -1, -1), -1)):
        for t in order:
            if want[t] == 0xFFFFFFFF != want[t - step]:
                want[t] = K._fill(want[t - step] ^ t)
    assert K.densify(sig).tolist() == want


@pytest.mark.parametrize(("k", "s"), [(9, 5), (21, 11)])
def test_open_syncmers(k, s):
    seq = sequence(400, 9)
    small = [x ^ 42 for x in plain_words(seq, s)]
    want = []
    for i, w in enumerate(plain_words(seq, k)):
        window = small[i : i + k - s + 1]
        least = min(window)
        if len(window) - 1 - window[::-1].index(least) == 0:
            want.append(w)
    assert K.syncmers(K.base_codes(seq.encode())[0], k, s).tolist() == want


def test_similarity_of_sketches():
    base, codes = sequence(20_000), lambda s: K.base_codes(s.encode())[0]
    changed = "".join("ACGT"[(CODE[b] + 1) % 4] if i % 20 == 0 else b for i, b in enumerate(base))
    a, b, c = (K.bottom_sketch(K.canonical_kmers(codes(s), 16), 1000) for s in (base, changed, sequence(20_000, 99)))
    assert len(a) == 1000 and np.all(np.diff(a.astype(object)) > 0)
    assert K.bottom_jaccard(a, a) == 1 and 0 < K.bottom_jaccard(a, b) < 1 and K.bottom_jaccard(a, c) < 0.01
    x, y = (K.densify(K.one_permutation(K.canonical_kmers(codes(s), 16), 512)[0]).astype(np.uint16) for s in (base, changed))
    assert K.jaccard_16(x, x) == 1 and K.jaccard_16(x, y) == pytest.approx(K.jaccard_matrix(x[None], y[None])[0, 0])


def test_wide_products_and_text():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 1 << 64, (2, 500), dtype=np.uint64)
    high, low = K.multiply_128(a, b)
    assert all((int(h) << 64) + int(l) == int(x) * int(y) for h, l, x, y in zip(high, low, a, b, strict=True))
    assert K.text_as_bases("Ab1\né") == "".join("N" if c.isdigit() else "ACGT"[ord(c) % 4] for c in "Ab1é").encode()
    assert K.fnv1a_hex("") == "cbf29ce484222325" and K.fnv1a_hex("a") == "af63dc4c8601ec8c"
    assert decompress(gzip.compress(b"ACGT")) == b"ACGT" == decompress(b"ACGT")
    assert np.linalg.norm(K.count_sketch(np.arange(100, dtype=np.uint16), 32)) == pytest.approx(1)


def test_spanning_tree_and_connectivity():
    u, v = np.array([0, 1, 2, 0, 3]), np.array([1, 2, 3, 2, 4])
    w, rank = np.array([0.1, 0.2, 0.9, 0.15, 0.3]), np.array([1, 2, 5, 1, 1])
    tree = graph.spanning_tree(5, u, v, w)
    assert tree.weights == [0.1, 0.15, 0.3, 0.9] and tree.components == 1 and tree.last_side == 2 and tree.second == 0.3
    assert graph.connectivity(5, u, v, rank) == 5 and graph.connectivity(6, u, v, rank) == -1
    assert graph.stable_neighbours({1: tree, 2: tree}) == 1


def test_farthest_points_cover_everything():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(200)
    for batch in (1, 16):
        reps, best, who = cover.farthest_points(x, ids, 0.2, batch=batch)
        assert (best > np.cos(0.2 * np.pi)).all() and np.isin(who, reps).all() and len(set(reps)) == len(reps)
    excluded = ids < 50
    reps, _, _ = cover.farthest_points(x, ids, 0.2, excluded=excluded)
    assert not excluded[reps].any()
    assert not len(cover.farthest_points(x, ids, 0.2, excluded=np.ones(200, bool))[0])
    same = np.ones((30, 2)) / np.sqrt(2)
    assert len(cover.farthest_points(same, np.arange(30), 0.1)[0]) == 1
    assert len(cover.merge_close(np.arange(30), same, 0.05)) == 1


def test_nystrom_keeps_similarities():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 16, (4, 400), dtype=np.uint16)
    sigs = np.stack([np.where(rng.random(400) < 0.2, rng.integers(0, 1 << 16, 400), base[i % 4]) for i in range(120)]).astype(np.uint16)
    at = stratified_anchors(rng.random(120), rng.random(120), min(60, anchor_count(120, 32)))
    model, own = Nystrom.fit(sigs[at], dim=32)
    vectors = model.embed(sigs)
    assert np.linalg.norm(vectors, axis=1) == pytest.approx(1) and np.linalg.norm(own, axis=1) == pytest.approx(1)
    near = vectors @ vectors.T
    np.fill_diagonal(near, -1)
    assert all(near[i].argmax() % 4 == i % 4 for i in range(120))


def test_identity_curve_is_monotone():
    x = np.linspace(0, 1, 200)
    curve = calibrate.IdentityCurve().fit(x, 0.7 + 0.3 * x)
    low, mid, high = curve.predict(x)
    assert (low <= mid).all() and (mid <= high).all() and curve.least_similarity(0.9) <= curve.safe_similarity(0.9)


def test_a_stack_of_signatures_is_filled_at_once(monkeypatch):
    rng, steps = np.random.default_rng(3), []
    stack = rng.integers(0, 1 << 32, (50, 64), dtype=np.uint64).astype(np.uint32)
    stack[rng.random(stack.shape) < rng.random((50, 1))] = K.EMPTY
    stack[7] = K.EMPTY
    want = [K.densify(row).tolist() for row in stack]
    fill = K._fill
    monkeypatch.setattr(K, "_fill", lambda x: steps.append(1) or fill(x))
    assert K.densify(stack).tolist() == want
    assert len(steps) <= 2 * 64  # not one step a bin of each row


def test_syncmers_across_breaks():
    seq = "N" + sequence(60, 5) + "NN" + sequence(12, 6) + "N" + sequence(90, 7)
    parts = [K.syncmers(K.base_codes(p.encode())[0], 11, 6).tolist() for p in seq.split("N")]
    assert K.syncmers(K.base_codes(seq.encode())[0], 11, 6).tolist() == sum(parts, [])
    assert K.distinct(np.array([3, 1, 3, 2, 1], np.uint64)).tolist() == [1, 2, 3] and not len(K.distinct(np.zeros(0, np.uint64)))
