"""Candidate links of the Jaccard join between very large sets."""

import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from lakecover.llm.jaccard import _size_step, _stars
from lakecover.llm.substrings import _kept, _Part


def linked(sizes, percent=80):
    """The nodes 1, 2, ... of these sizes, which share one key, that the first of them is linked to."""
    keys, nodes, steps = np.full(len(sizes), 9, np.uint64), np.arange(1, len(sizes) + 1), _size_step(np.array(sizes))
    got = _stars(pa.table({"keys": [keys.tobytes()], "nodes": [nodes.tobytes()], "steps": [steps.tobytes()]}), percent)
    return {(a, b) for a, b in zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True)}


@pytest.mark.parametrize("sizes", [(265_000, 266_500), (213_000, 266_000), (266_000, 332_000), (20_000, 20_500), (10**12, 10**12 + 1)])
def test_sizes_within_the_similarity_are_linked(sizes):
    assert linked(sizes) == {(1, 2)}


def test_sizes_beyond_the_similarity_are_not():
    assert linked((100, 266_000)) == set() and linked((1, 266_000, 270_000)) == {(2, 3)}


def test_size_steps_rise():
    steps = _size_step(np.geomspace(1, 1e15, 5000).astype(np.int64)).astype(np.int64)
    assert (np.diff(steps) >= 0).all() and steps[-1] > 255


def test_kept_words_are_joined_few_rows_at_a_time():
    """No array has a number for each byte of a part: beyond the part itself some 9 bytes a byte of text are held (before: 20)."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 100_000, 1500)) for _ in range(400)] + ["", "one  two\tthree", None]
    packer = zstandard.ZstdCompressor()
    table = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array([None if t is None else packer.compress(t.encode()) for t in texts], pa.binary())})
    part = _Part(table, 13)
    removed = rng.random(len(part.row)) < 0.1
    tracemalloc.start()
    whole, digests = _kept(part, removed, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 9 * len(part.words.data)
    words = [w for t in texts for w in (t or "").split()]
    kept, first = [w if stay else None for w, stay in zip(words, ~removed, strict=True)], part.words.first
    want = [" ".join(w for w in kept[i:j] if w is not None) for i, j in zip(first[:-1], first[1:], strict=True)]
    assert whole == want and digests == [hashlib.sha256(t.encode()).hexdigest() for t in want]
