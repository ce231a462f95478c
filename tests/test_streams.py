"""Files sketched piece by piece give the sketch of the whole."""

import gzip
import io
import random
import tracemalloc

import pytest
import zstandard

from lakecover.operators.sketch import PartialSketch, sketch_files, sketch_payloads
from lakecover.sources.streams import chunks, opened


def fasta(rng, n):
    out = []
    for c in range(n):
        out.append(f">c{c} some > words" if rng.random() < 0.8 else ">")
        body = "".join(rng.choice("ACGTACGTACGTacgtN") for _ in range(rng.randrange(400)))
        out += [body[i : i + 60] + ("\r" if rng.random() < 0.1 else "") for i in range(0, len(body), 60)]
        if rng.random() < 0.2:
            out.append("AC>GT")
    return ("\n".join(out) + rng.choice(("", "\n", "\n>end"))).encode()


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    rng, folder, out = random.Random(4), tmp_path_factory.mktemp("fasta"), []
    for i in range(12):
        data = fasta(rng, rng.randrange(1, 12))
        half = len(data) // 2
        stored = (data, gzip.compress(data), gzip.compress(data[:half]) + gzip.compress(data[half:]) + b"\0\0", zstandard.compress(data), zstandard.compress(data[:half]) + zstandard.compress(data[half:]))[i % 5]
        (folder / f"f{i}").write_bytes(stored)
        out.append((f"f{i}", str(folder / f"f{i}"), data))
    for name, data in (("empty", b""), ("header", b">only"), ("plain", b"ACGTACGTAGCATCGACT" * 30)):
        (folder / name).write_bytes(data)
        out.append((name, str(folder / name), data))
    return out


@pytest.mark.parametrize("size", [1, 5, 64, 1 << 20])
def test_pieces_join_to_the_contents(files, size):
    for _, path, data in files:
        with opened(path) as stream:
            assert b"".join(chunks(stream, size)) == data


@pytest.mark.parametrize(("piece", "syncmer"), [(4, 0), (7, 5), (1000, 0), (1 << 20, 5)])
def test_sketches_of_pieces(spark, files, piece, syncmer):
    paths = spark.createDataFrame([(i, f"file:{p}" if i == "f1" else p) for i, p, _ in files], "id string, file string")
    whole = spark.createDataFrame([(i, bytearray(d)) for i, _, d in files], "id string, payload binary")
    got = {r.id: r.asDict() for r in sketch_files(paths, "id", "file", k=11, bins=64, syncmer=syncmer, second=True, piece=piece).collect()}
    want = {r.id: r.asDict() for r in sketch_payloads(whole, "id", "payload", k=11, bins=64, syncmer=syncmer, second=True).collect()}
    assert got == want


def test_faults_are_error_rows(spark, tmp_path):
    (tmp_path / "cut.gz").write_bytes(gzip.compress(b"ACGT" * 5000)[:-20])
    rows = spark.createDataFrame([("cut", str(tmp_path / "cut.gz")), ("gone", str(tmp_path / "none")), ("null", None)], "id string, file string")
    got = {r.id: r.error for r in sketch_files(rows, "id", "file", k=5, bins=16).collect()}
    assert "EOFError" in got["cut"] and "FileNotFoundError" in got["gone"] and got["null"] == "ValueError: no file"


def test_memory_does_not_follow_the_file():
    rng = random.Random(1)
    block = "".join(rng.choice("ACGT") for _ in range(50_000)).encode() + b"\n"
    packed = gzip.compress(block * 800, 1)
    tracemalloc.start()
    made = PartialSketch(21, 256)
    for piece in chunks(io.BytesIO(packed), 1 << 16):
        made.add(piece)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made.bases == 800 * 50_000 and peak < 12 << 20
