"""Embeddings of networks and profiles in the unit ball (or the plane): distances with gradients, and a small trainer in memory.

``models.distributed`` trains over tables; this one is for a few thousand triplets at hand.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd

EPS = 1e-5


@dataclass
class Config:
    dim: int = 24
    heads: int = 2
    geometry: str = "hyperbolic"
    epochs: int = 60
    positives: int = 16
    negatives: int = 48
    margin: float = 1.0
    leak: float = 0.2
    hop_gap: float = 0.1
    rate: float = 0.02
    patience: int = 10
    stop_after: int = 25
    seed: int = 1


@dataclass
class Result:
    as_vec: np.ndarray
    heads: np.ndarray
    losses: list[float] = field(default_factory=list)


def distance(a: np.ndarray, b: np.ndarray, geometry: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distances of matching rows and their gradients by both."""
    diff = a - b
    gap = (diff * diff).sum(-1)
    if geometry == "euclidean":
        d = np.sqrt(gap + EPS * EPS)
        g = diff / d[..., None]
        return d, g, -g
    x, y = np.maximum(1 - (a * a).sum(-1), EPS), np.maximum(1 - (b * b).sum(-1), EPS)
    z = 1 + 2 * gap / (x * y)
    root = np.sqrt(np.maximum(z * z - 1, EPS))
    by_a = (4 / (x * y * root))[..., None] * (diff + (gap / x)[..., None] * a)
    by_b = (4 / (x * y * root))[..., None] * (-diff + (gap / y)[..., None] * b)
    return np.arccosh(np.maximum(z, 1)), by_a, by_b


def inside(v: np.ndarray, geometry: str) -> np.ndarray:
    if geometry == "euclidean":
        return v
    n = np.linalg.norm(v, axis=-1, keepdims=True)
    return np.where(n > 1 - EPS, v / np.maximum(n, EPS) * (1 - EPS), v)


class Adam:
    """Adam whose gradients are scaled by the ball's metric."""

    def __init__(self, v: np.ndarray, geometry: str):
        self.m, self.s, self.t, self.geometry = np.zeros_like(v), np.zeros(v.shape[:-1] + (1,)), 0, geometry

    def step(self, v: np.ndarray, g: np.ndarray, rate: float) -> np.ndarray:
        if self.geometry != "euclidean":
            g = g * ((1 - (v * v).sum(-1, keepdims=True)) ** 2 / 4)
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.s = 0.999 * self.s + 0.001 * (g * g).sum(-1, keepdims=True)
        update = self.m / (1 - 0.9**self.t) / (np.sqrt(self.s / (1 - 0.999**self.t)) + 1e-8)
        return inside(v - rate * update, self.geometry)


def sample(offsets: np.ndarray, per: int, rng: np.random.Generator) -> np.ndarray:
    """``per`` uniform draws with replacement from each profile's triplets (CSR offsets)."""
    n = np.diff(offsets)
    return offsets[:-1, None] + (rng.random((len(n), per)) * n[:, None]).astype(np.int64)


def train(triplets: pd.DataFrame, n_as: int, cfg: Config) -> Result:
    """triplets: profile, as_id, hop, weight, with dense ids. Margin loss: a profile's own networks nearer than others."""
    rng = np.random.default_rng(cfg.seed)
    t = triplets.sort_values(["profile", "as_id"])
    n_profiles = int(t["profile"].max()) + 1
    offsets = np.searchsorted(t["profile"].to_numpy(), np.arange(n_profiles + 1))
    as_id, hop, weight = (t[c].to_numpy() for c in ("as_id", "hop", "weight"))
    scale = (0.2, 0.05) if cfg.geometry == "euclidean" else (0.5, 0.01)
    a = inside(rng.normal(0, scale[0] / np.sqrt(cfg.dim), (n_as, cfg.dim)), cfg.geometry)
    h = inside(rng.normal(0, scale[1], (n_profiles, cfg.heads, cfg.dim)), cfg.geometry)
    opt_a, opt_h = Adam(a, cfg.geometry), Adam(h, cfg.geometry)
    best, idle, waited, rate, losses = np.inf, 0, 0, cfg.rate, []
    keep = (a, h)
    for _ in range(cfg.epochs):
        pos = sample(offsets, cfg.positives, rng)
        pa, neg = as_id[pos], rng.integers(0, n_as, (n_profiles, cfg.negatives))
        near, far = _to_heads(h, a[pa], cfg), _to_heads(h, a[neg], cfg)
        hardest = np.sort(far[0], axis=1)[:, : cfg.positives]
        gap = cfg.margin + near[0] - hardest.mean(axis=1, keepdims=True)
        w = weight[pos] / weight[pos].sum(axis=1, keepdims=True)
        on = (gap > 0) * w
        loss = float((np.maximum(gap, 0) * w).sum(axis=1).mean())
        # nearer networks come first
        order = np.argsort(hop[pos], axis=1)
        i, j = order[:, 0], order[:, -1]
        r = np.arange(n_profiles)
        rank = near[0][r, i] - near[0][r, j] + cfg.hop_gap * (hop[pos][r, j] - hop[pos][r, i])
        wrong = (rank > 0) & (hop[pos][r, j] > hop[pos][r, i])
        loss += float(np.where(wrong, rank, 0).mean())
        up = on.copy()
        up[r, i] += wrong * 0.1
        up[r, j] -= wrong * 0.1
        down = np.zeros_like(far[0])
        np.put_along_axis(down, np.argsort(far[0], axis=1)[:, : cfg.positives], -on.sum(axis=1, keepdims=True) / cfg.positives, axis=1)
        ga, gh = np.zeros_like(a), np.zeros_like(h)
        for (_, owner, by_h, by_a), ids, coef in ((near, pa, up), (far, neg, down)):
            np.add.at(ga, ids, coef[..., None] * by_a)
            np.add.at(gh, (r[:, None], owner), coef[..., None] * by_h)
            if cfg.heads > 1:  # other heads follow a little
                np.add.at(gh, (r[:, None], (owner + 1) % cfg.heads), cfg.leak * coef[..., None] * by_h)
        a, h = opt_a.step(a, ga / n_profiles * 10, rate), opt_h.step(h, gh, rate)
        losses.append(loss)
        if loss < best - 1e-4:
            best, idle, waited, keep = loss, 0, 0, (a, h)
        else:
            idle, waited = idle + 1, waited + 1
            if waited >= cfg.patience:
                rate, waited = rate / 2, 0
            if idle >= cfg.stop_after:
                break
    return Result(*keep, losses)


def _to_heads(h: np.ndarray, v: np.ndarray, cfg: Config) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distance to the nearest head, that head, and the gradients."""
    d, gh, ga = distance(h[:, None, :, :], v[:, :, None, :], cfg.geometry)
    k = d.argmin(-1)
    pick = lambda x: np.take_along_axis(x, k[..., None, None], 2)[:, :, 0]
    return np.take_along_axis(d, k[..., None], 2)[..., 0], k, pick(gh), pick(ga)
