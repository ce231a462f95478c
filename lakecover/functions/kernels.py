"""Numeric kernels on arrays: k-mer hashing, sketches and what compares them."""

from __future__ import annotations

import numpy as np

# The hash constants of the sketch format.
WY_0 = 0xA0761D6478BD642F
WY_1 = 0xE7037ED1A0B428DB
MURMUR_1 = 0xFF51AFD7ED558CCD
MURMUR_2 = 0xC4CEB9FE1A85EC53
SPLITMIX_1 = 0xBF58476D1CE4E5B9
SPLITMIX_2 = 0x94D049BB133111EB
PROJECT_1 = 0x9E3779B97F4A7C15
PROJECT_2 = 0x6C62272E07BB0142
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3
SEED_1 = 42
SEED_2 = 1337

EMPTY = np.uint32(0xFFFFFFFF)
_MASK = (1 << 64) - 1
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)

BASE_CODE = np.full(256, 255, np.uint8)
for _code, _letters in enumerate((b"Aa", b"Cc", b"Gg", b"Tt")):
    BASE_CODE[list(_letters)] = _code


def multiply_128(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """High and low halves of unsigned 64 x 64 bit products."""
    a, b = np.asarray(a, np.uint64), np.asarray(b, np.uint64)
    a1, a0, b1, b0 = a >> _32, a & _LOW, b >> _32, b & _LOW
    low, cross1, cross2 = a0 * b0, a1 * b0, a0 * b1
    middle = (low >> _32) + (cross1 & _LOW) + (cross2 & _LOW)
    return a1 * b1 + (cross1 >> _32) + (cross2 >> _32) + (middle >> _32), (middle << _32) | (low & _LOW)


def fold_multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    high, low = multiply_128(a, b)
    return high ^ low


def bin_hash(canonical: np.ndarray, seed: int) -> np.ndarray:
    return fold_multiply(canonical ^ np.uint64((seed + WY_0) & _MASK), canonical ^ np.uint64(WY_1))


def fast_range(h: np.ndarray, n: int) -> np.ndarray:
    """floor(h * n / 2^64); of a number of 32 bits from two products."""
    if n >> 32:
        return multiply_128(h, np.uint64(n))[0].astype(np.int64)
    h, n = np.asarray(h, np.uint64), np.uint64(n)
    return (((h >> _32) * n + (((h & _LOW) * n) >> _32)) >> _32).astype(np.int64)


def _finalise(x: np.ndarray, shifts: tuple[int, int, int], factors: tuple[int, int]) -> np.ndarray:
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        for shift, factor in zip(shifts, (*factors, 1), strict=True):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x


def murmur(x: np.ndarray) -> np.ndarray:
    return _finalise(x, (33, 33, 33), (MURMUR_1, MURMUR_2))


def splitmix(x: np.ndarray) -> np.ndarray:
    return _finalise(x, (30, 27, 31), (SPLITMIX_1, SPLITMIX_2))


def fnv1a_hex(text: str) -> str:
    h = FNV_OFFSET
    for byte in text.encode():
        h = ((h ^ byte) * FNV_PRIME) & _MASK
    return f"{h:016x}"


def base_codes(payload: bytes) -> tuple[np.ndarray, int, int]:
    """Codes of a FASTA or plain sequence (255 breaks words), number of bases, number of headers.

    Header lines break words; line ends don't. Anything but ACGT breaks them too.
    """
    data = np.frombuffer(payload, np.uint8)
    starts = np.flatnonzero(data == 0x3E)
    starts = starts[(starts == 0) | (data[np.maximum(starts - 1, 0)] == 0x0A)]
    keep = (data != 0x0A) & (data != 0x0D)
    codes = BASE_CODE[data]
    if len(starts):
        line_ends = np.append(np.flatnonzero(data == 0x0A), len(data))
        edge = np.zeros(len(data) + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, line_ends[np.searchsorted(line_ends, starts)], -1)
        header = np.cumsum(edge[:-1]) > 0
        keep &= ~header
        keep[starts] = True  # one break stands for the header
        codes = codes.copy()
        codes[starts] = 255
    codes = codes[keep]
    return codes, int((codes < 4).sum()), len(starts)


def text_as_bases(text: str) -> bytes:
    """Any text as a sequence: code point modulo 4 picks a base, a digit breaks, line feeds vanish."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    points = points[points != 10]
    out = np.frombuffer(b"ACGT", np.uint8)[points % 4]
    return np.where((points >= 48) & (points <= 57), np.uint8(ord("N")), out).tobytes()


def _strands(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The smaller strand of the word at each position, and which words are whole: words of k bases are joined from those of 1, 2, 4, ..."""
    n = len(codes)
    if not 1 <= k <= 32 or n < k:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    base = (codes & 3).astype(np.uint64)
    part, other, m = base, base ^ np.uint64(3), 1
    forward, reverse, length, rest = part, other, 0, k
    while rest:
        if rest & 1 and not length:
            forward, reverse, length = part, other, m
        elif rest & 1:
            size = n - length - m + 1
            forward = (forward[:size] << np.uint64(2 * m)) | part[length:]
            reverse = reverse[:size] | (other[length:] << np.uint64(2 * length))
            length += m
        rest >>= 1
        if rest:
            size = n - 2 * m + 1
            part, other, m = (part[:size] << np.uint64(2 * m)) | part[m:], other[:size] | (other[m:] << np.uint64(2 * m)), 2 * m
    broken = np.concatenate([[0], np.cumsum(codes > 3)])
    return np.minimum(forward, reverse), broken[k:] == broken[:-k]


def canonical_kmers(codes: np.ndarray, k: int) -> np.ndarray:
    """The smaller of each whole word's two strands, two bits a base, in order of position."""
    words, whole = _strands(codes, k)
    return words[whole]


def distinct(words: np.ndarray) -> np.ndarray:
    """The distinct words in order: a sort, which is faster than ``np.unique`` by hashing."""
    words = np.sort(words)
    return words[np.append(True, words[1:] != words[:-1])] if len(words) else words


def syncmers(codes: np.ndarray, k: int, s: int, seed: int = SEED_1) -> np.ndarray:
    """Open syncmers: the k-mers whose smallest s-mer is the first; of equal ones the rightmost counts.

    The first is less than the least of the k - s after it, which are found for all positions at once from minima of 1, 2, 4, ...
    """
    if not 0 < s < k:
        return canonical_kmers(codes, k)
    words, whole = _strands(codes, k)
    if not len(words):
        return words
    small = _strands(codes, s)[0] ^ np.uint64(seed)
    least, m = small[1:], 1
    while 2 * m <= k - s:
        least, m = np.minimum(least[:-m], least[m:]), 2 * m
    more = k - s - m
    least = np.minimum(least[:-more], least[more:]) if more else least
    return words[whole & (small[: len(words)] < least)]


def shingle_words(text: str, k: int = 8) -> np.ndarray:
    """Windows of k <= 8 UTF-8 bytes packed big-endian: the sequence words of ordinary text."""
    data = np.frombuffer(text.encode(), np.uint8).astype(np.uint64)
    out = np.zeros(max(0, len(data) - k + 1), np.uint64)
    for i in range(k):
        out = (out << np.uint64(8)) | data[i : i + len(out)]
    return out


def one_permutation(words: np.ndarray, bins: int, seed: int = SEED_1) -> tuple[np.ndarray, np.ndarray]:
    """Smallest upper hash half of each bin (EMPTY if none), and which bins hold a word's hash."""
    signature = np.full(bins, EMPTY, np.uint32)
    if len(words):
        h = bin_hash(words, seed)
        np.minimum.at(signature, fast_range(h, bins), (h >> _32).astype(np.uint32))
    return signature, signature != EMPTY


DENSE_BINS = 1 << 19  # Bins that are filled at a time.


def densify(signature: np.ndarray) -> np.ndarray:
    """Fill empty bins from their left neighbour's value, then those before the first value from the right; of one signature or a stack of them.

    A run of empty bins is filled bin after bin; all runs at once, so steps are as many as the longest run.
    """
    if signature.ndim == 1:
        return densify(signature[None, :])[0]
    rows, bins = signature.shape
    step = max(1, DENSE_BINS // max(1, bins))
    if rows > step:
        return np.concatenate([densify(signature[i : i + step]) for i in range(0, rows, step)])
    out = signature.ravel().copy()
    full = np.flatnonzero(out != EMPTY)
    if not len(full) or len(full) == len(out):
        return out.reshape(rows, bins)
    row = full // bins
    other = np.diff(row) != 0
    last, first = np.append(other, True), np.concatenate([[True], other])
    ends, t = np.where(last, (row + 1) * bins, np.append(full[1:], 0)), full + 1
    while len(t := t[live := t < ends]):
        ends = ends[live]
        out[t] = _fill(out[t - 1] ^ (t % bins).astype(np.uint64))
        t = t + 1
    t, ends = full[first] - 1, row[first] * bins
    while len(t := t[live := t >= ends]):
        ends = ends[live]
        out[t] = _fill(out[t + 1] ^ (t % bins).astype(np.uint64))
        t = t - 1
    return out.reshape(rows, bins)


def _fill(x: np.ndarray) -> np.ndarray:
    return (splitmix(x) >> _32).astype(np.uint32)


def bottom_sketch(words: np.ndarray, size: int, seed: int = SEED_1) -> np.ndarray:
    """The smallest distinct hashes, ascending."""
    return distinct(murmur(words ^ np.uint64(seed)))[:size]


def bottom_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    small = min(len(a), len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / small if small else 0.0


def jaccard_16(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two 16-bit signatures without matches by chance."""
    m = min(len(a), len(b))
    if not m:
        return 0.0
    chance = 2.0**-16
    return max(0.0, (np.count_nonzero(a[:m] == b[:m]) / m - chance) / (1 - chance))


def jaccard_matrix(a: np.ndarray, b: np.ndarray, block: int = 64) -> np.ndarray:
    """Corrected similarities of all rows of two stacks of 16-bit signatures."""
    out = np.empty((len(a), len(b)))
    for i in range(0, len(a), block):
        out[i : i + block] = (a[i : i + block, None, :] == b[None, :, :]).mean(axis=2) if len(b) * a.shape[1] * block < 1 << 28 else np.stack([(row == b).mean(axis=1) for row in a[i : i + block]])
    chance = 2.0**-16
    return np.maximum(0.0, (out - chance) / (1 - chance))


def containment_16(query: np.ndarray, query_real: np.ndarray, reference: np.ndarray) -> float:
    """Share of the query's own bins that the reference matches."""
    n = int(query_real.sum())
    return float(np.count_nonzero((query == reference) & query_real) / n) if n else 0.0


def count_sketch(signature16: np.ndarray, dim: int) -> np.ndarray:
    """Unit vector whose dot products estimate the share of equal bins."""
    t = np.arange(len(signature16), dtype=np.uint64)
    value = signature16.astype(np.uint64)
    with np.errstate(over="ignore"):
        place = splitmix(value + t * np.uint64(PROJECT_1)) % np.uint64(dim)
        sign = np.where(splitmix(value + t * np.uint64(PROJECT_2)) & np.uint64(1), 1.0, -1.0)
    out = np.zeros(dim)
    np.add.at(out, place.astype(np.int64), sign)
    norm = np.linalg.norm(out)
    return (out / norm if norm > 1e-10 else out).astype(np.float32)
