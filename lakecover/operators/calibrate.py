"""Choosing sketch sizes from a sample, and mapping similarity to identity."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..functions.kernels import count_sketch

TIERS = ((99.0, (31, 20_000, 512)), (95.0, (21, 10_000, 256)), (0.0, (16, 5_000, 128)))  # least ANI: k, bins, dimensions


def calibrated_tier(signatures: np.ndarray, k: int, dim: int = 256, pairs: int = 50, seed: int = 42) -> tuple[float, tuple[int, int, int]]:
    """(ANI at the 95th percentile distance of random pairs, its tier)."""
    rng, n = np.random.default_rng(seed), len(signatures)
    vectors = np.stack([count_sketch(s, dim) for s in signatures]).astype(float)
    distances = []
    for _ in range(pairs):
        a, b = rng.choice(n, 2, replace=False)
        distances.append(float(np.arccos(np.clip(vectors[a] @ vectors[b], -1, 1)) / np.pi))
    distances.sort()
    d = distances[len(distances) * 95 // 100]
    j = np.cos(d * np.pi)
    ani = 100.0 if d <= 0 else 70.0 if d >= 0.5 or j <= 0 else float(np.clip(100 * (2 * j / (1 + j)) ** (1 / k), 70, 100))
    return ani, next(t for least, t in TIERS if ani >= least)


@dataclass
class IdentityCurve:
    """Monotone quantile curves of identity over similarity, with a margin on either side, and their inverses."""

    margin: float = 0.02
    bins: int = 32

    def fit(self, similarity: np.ndarray, identity: np.ndarray) -> IdentityCurve:
        order = np.argsort(similarity, kind="stable")
        parts = [p for p in np.array_split(order, min(self.bins, len(order))) if len(p)]
        self.x = np.array([similarity[p].mean() for p in parts])
        low, mid, high = (np.array([np.quantile(identity[p], q) for p in parts]) for q in (0.05, 0.5, 0.95))
        rise = np.maximum.accumulate
        self.mid, self.low, self.high = rise(mid), rise(low - self.margin), rise(high + self.margin)
        return self

    def predict(self, similarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.interp(similarity, self.x, curve) for curve in (self.low, self.mid, self.high))

    def least_similarity(self, identity: float) -> float:
        """From here on the identity may be reached."""
        return float(np.interp(identity, self.high, self.x))

    def safe_similarity(self, identity: float) -> float:
        """From here on the identity is reached."""
        return float(np.interp(identity, self.low, self.x))
